"""Queries of audits, units, readouts, distributions and group means (S, U, T, X, L, R, E, G)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from layerroutes.functions.hashing import uniform
from layerroutes.functions.stats import running
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql, uniform_sql
from layerroutes.plans.registry import query
from layerroutes.plans.tables import TOK

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
AUDIT = "a AS (SELECT row_id, layer, CASE WHEN row_id % 89 = 0 THEN -1 WHEN row_id % 83 = 0 THEN state + 10 ELSE state END AS state, row_id % 50 AS grp, CASE WHEN row_id % 97 = 0 THEN 'test' WHEN row_id % 50 < 30 THEN 'train' ELSE 'val' END AS part, row_id % 50 < 31 AS fit FROM routes WHERE row_id % 101 <> 0 OR layer <> 5)"


@query(sql(AUDIT + ", l AS (SELECT row_id FROM a GROUP BY row_id HAVING count(DISTINCT layer) <> 8), g AS (SELECT grp FROM a GROUP BY grp HAVING count(DISTINCT part) > 1) SELECT 'layers' AS rule, count(*) AS n FROM l UNION ALL SELECT 'negative', count(*) FROM a WHERE state < 0 UNION ALL SELECT 'outside', count(*) FROM a WHERE state >= 0 AND (layer, state) NOT IN (SELECT (layer, state) FROM centers) UNION ALL SELECT 'two_parts', count(*) FROM g UNION ALL SELECT 'fit_not_train', count(DISTINCT row_id) FROM a WHERE fit AND part <> 'train'", "routes"))
def s17_audit(spark, d):
    """Checks of a stored result, on routes with faults planted by id."""
    row, state = F.col("row_id"), F.col("state")
    a = fx.routes(spark, d).where("row_id % 101 <> 0 or layer <> 5").select(
        "row_id", "layer", F.when(row % 89 == 0, -1).when(row % 83 == 0, state + 10).otherwise(state).alias("state"), (row % 50).alias("grp"),
        F.when(row % 97 == 0, "test").when(row % 50 < 30, "train").otherwise("val").alias("part"), (row % 50 < 31).alias("fit"),
    )
    found = {
        "layers": a.groupBy("row_id").agg(F.countDistinct("layer").alias("k")).where(F.col("k") != fx.LAYERS),
        "negative": a.where("state < 0"),
        "outside": a.where("state >= 0").join(fx.centers(spark, d).select("layer", "state"), ["layer", "state"], "left_anti"),
        "two_parts": a.groupBy("grp").agg(F.countDistinct("part").alias("k")).where("k > 1"),
        "fit_not_train": a.where("fit and part <> 'train'").select("row_id").distinct(),
    }
    out = None
    for rule, rows in found.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = n if out is None else out.union(n)
    return out


@query(sql("SELECT d.doc_id, lang, source, d.label, layer, state FROM doc d JOIN routes r ON r.row_id = d.doc_id WHERE d.label = 0", "doc", "routes"))
def s18_case_export(spark, d):
    cases = fx.doc(spark, d).where("label = 0").select("doc_id", "lang", "source", "label")
    return cases.join(fx.routes(spark, d).select(F.col("row_id").alias("doc_id"), "layer", "state"), "doc_id")


@query("WITH " + TOK + " SELECT doc_id, pos AS token_end, count(*) OVER w AS n_tokens, pos = count(*) OVER w AS is_final FROM tok WINDOW w AS (PARTITION BY doc_id)")
def u05_token_units(spark, d):
    """Each token's place, with the size of its text, which is told once a text."""
    words = fx.table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    t = words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), "words").select("doc_id", "n_tokens", F.posexplode("words").alias("p", "token"))
    return t.select("doc_id", (F.col("p") + 1).alias("token_end"), "n_tokens", (F.col("p") + 1 == F.col("n_tokens")).alias("is_final"))


def coordinates(spark, d):
    """row_id, layer, i (from 1), v."""
    return fx.states(spark, d).select("row_id", "layer", F.posexplode("x").alias("p", "v")).select("row_id", "layer", (F.col("p") + 1).cast("long").alias("i"), "v")


@query(sql("e AS (SELECT category, layer, i, x[i] AS v FROM states JOIN emb USING (row_id), range(1, 9) t(i)), g AS (SELECT category, layer, i, avg(v) AS m, avg(v * v) AS s FROM e GROUP BY ALL), k AS (SELECT layer, i, avg(v) AS c FROM e GROUP BY ALL) SELECT category, layer, round(sum(s - 2 * m * c + c * c) / 8, 6) AS energy FROM g JOIN k USING (layer, i) GROUP BY ALL", "states", "emb"))
def u13_centred_energy(spark, d):
    """Mean squared distance of each category from the layer's centre, from first and second moments."""
    e = coordinates(spark, d).join(fx.emb(spark, d).select("row_id", "category"), "row_id")
    g = e.groupBy("category", "layer", "i").agg(F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("s"))
    k = e.groupBy("layer", "i").agg(F.avg("v").alias("c"))
    m, s, c = map(F.col, ("m", "s", "c"))
    return g.join(k, ["layer", "i"]).groupBy("category", "layer").agg(r6(F.sum(s - 2 * m * c + c * c) / fx.WIDTH, "energy"))


@query(f"SELECT id, CASE WHEN 10 * i <= 5 * n THEN 'train' WHEN 10 * i <= 7 * n THEN 'tuning' WHEN 10 * i <= 9 * n THEN 'calibration' ELSE 'test' END AS role FROM (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {uniform_sql('role', 'o_orderkey')}) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def u18_roles(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), uniform("role", F.col("o_orderkey")).alias("u"), F.lit(1).alias("one"))
    k = running(o, ["s"], "u", {"i": "one"}).join(o.groupBy("s").agg(F.count("*").alias("n")), "s")
    i, n = 10 * F.col("i"), F.col("n")
    return k.select("id", F.when(i <= 5 * n, "train").when(i <= 7 * n, "tuning").when(i <= 9 * n, "calibration").otherwise("test").alias("role"))


@query(sql(f"e AS (SELECT row_id, layer, i, x[i] AS v FROM states, range(1, 9) t(i)), k AS (SELECT layer, i, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE {uniform_sql('fit', 'row_id')} < 0.7 GROUP BY ALL) SELECT row_id, layer, i, round((v - m) / s, 6) AS z FROM e JOIN k USING (layer, i)", "states"))
def t05_train_only_scaling(spark, d):
    e = coordinates(spark, d)
    k = e.where(uniform("fit", F.col("row_id")) < 0.7).groupBy("layer", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return e.join(k, ["layer", "i"]).select("row_id", "layer", "i", r6((F.col("v") - F.col("m")) / F.col("s"), "z"))


@query(sql("tr AS (SELECT * FROM evt WHERE sample % 3 = 0), k AS (SELECT token_end, avg(score) AS m FROM tr GROUP BY token_end) SELECT sample, e.token_end, round(coalesce(m, (SELECT avg(score) FROM tr)) + 1e-9, 6) AS fitted FROM evt e LEFT JOIN k USING (token_end)", "evt"))
def x02_group_means(spark, d):
    """Means by position of the training samples; positions they lack get their mean of all."""
    e = fx.evt(spark, d).select("sample", "token_end", "score")
    train = e.where("sample % 3 = 0")
    k = train.groupBy("token_end").agg(F.avg("score").alias("m"))
    whole = F.broadcast(train.agg(F.avg("score").alias("whole")))  # one row
    return e.join(k, "token_end", "left").join(whole).select("sample", "token_end", F.round(F.coalesce("m", "whole") + 1e-9, 6).alias("fitted"))


NB = "tr AS (SELECT * FROM rt WHERE row_id % 2 = 0), n AS (SELECT layer, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, count(DISTINCT state) AS k FROM tr GROUP BY layer), c AS (SELECT layer, state, count(*) FILTER (label = 1) AS c1, count(*) FILTER (label = 0) AS c0 FROM tr GROUP BY ALL), lr AS (SELECT row_id, layer, ln((n1 + 1) / (n0 + 1)) AS prior, ln((coalesce(c1, 0) + 1) / (n1 + k)) - ln((coalesce(c0, 0) + 1) / (n0 + k)) AS ratio FROM rt JOIN n USING (layer) LEFT JOIN c USING (layer, state) WHERE row_id % 2 = 1)"


def log_ratios(spark, d):
    """Rows not trained on: smoothed log prior odds and log likelihood ratio of each layer's state."""
    rt = fx.rt(spark, d).select("row_id", "layer", "state", "label")
    train = rt.where("row_id % 2 = 0")
    side = lambda y: F.count(F.when(F.col("label") == y, 1))
    n = train.groupBy("layer").agg(side(1).alias("n1"), side(0).alias("n0"), F.countDistinct("state").alias("k"))
    c = train.groupBy("layer", "state").agg(side(1).alias("c1"), side(0).alias("c0"))
    x = rt.where("row_id % 2 = 1").join(n, "layer").join(c, ["layer", "state"], "left")
    one = lambda y: F.log((F.coalesce(f"c{y}", F.lit(0)) + 1) / (F.col(f"n{y}") + F.col("k")))
    return x.select("row_id", "layer", F.log((F.col("n1") + 1) / (F.col("n0") + 1)).alias("prior"), (one(1) - one(0)).alias("ratio"))


@query(sql(NB + " SELECT row_id, round(prior + ratio, 6) AS log_odds FROM lr WHERE layer = 7", "rt"))
def l07_state_bayes(spark, d):
    return log_ratios(spark, d).where(F.col("layer") == fx.LAYERS - 1).select("row_id", r6(F.col("prior") + F.col("ratio"), "log_odds"))


@query(sql(NB + " SELECT row_id, layer + 1 AS layers, round(prior + sum(ratio) OVER (PARTITION BY row_id ORDER BY layer), 6) AS log_odds FROM lr", "rt"))
def l15_progressive(spark, d):
    """Log-odds with the first m layers only, all m in one pass."""
    w = Window.partitionBy("row_id").orderBy("layer")
    return log_ratios(spark, d).select("row_id", (F.col("layer") + 1).alias("layers"), r6(F.col("prior") + F.sum("ratio").over(w), "log_odds"))


@query(sql("v AS (SELECT layer, state, row_number() OVER (PARTITION BY layer ORDER BY state) - 1 AS code FROM (SELECT DISTINCT layer, state FROM routes WHERE row_id % 2 = 0 AND state <> 3)), k AS (SELECT layer, count(*) AS k FROM v GROUP BY layer) SELECT row_id, r.layer, coalesce(code, k)::INT AS code FROM routes r JOIN k USING (layer) LEFT JOIN v ON v.layer = r.layer AND v.state = r.state", "routes"))
def r01_vocabulary(spark, d):
    """Dense codes of the training states of each layer; the code after them is for any other."""
    r = fx.routes(spark, d).select("row_id", "layer", "state")
    v = r.where("row_id % 2 = 0 and state <> 3").select("layer", "state").distinct()
    v = v.withColumn("code", F.row_number().over(Window.partitionBy("layer").orderBy("state")) - 1)  # over the vocabulary
    k = v.groupBy("layer").agg(F.count("*").cast("int").alias("k"))
    return r.join(k, "layer").join(v, ["layer", "state"], "left").select("row_id", "layer", F.coalesce("code", "k").alias("code"))


@query(sql("s AS (SELECT sample, event_type AS a, lead(event_type) OVER (PARTITION BY sample ORDER BY token_end) AS b FROM evt), f AS (SELECT sample, 'state' AS kind, a AS feature, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT sample, 'pair', a || '>' || b, count(*) FROM s WHERE b IS NOT NULL GROUP BY ALL) SELECT sample, kind, feature, round(n / sum(n) OVER (PARTITION BY sample, kind), 6) AS share FROM f", "evt"))
def r09_order_features(spark, d):
    s = fx.evt(spark, d).select("sample", F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("sample").orderBy("token_end")).alias("b"))
    kinds = F.array(F.struct(F.lit("state").alias("kind"), F.col("a").alias("feature")), F.struct(F.lit("pair").alias("kind"), F.concat("a", F.lit(">"), "b").alias("feature")))
    f = s.select("sample", F.inline(kinds)).where("feature is not null").groupBy("sample", "kind", "feature").agg(F.count("*").alias("n"))
    return f.select("sample", "kind", "feature", r6(F.col("n") / F.sum("n").over(Window.partitionBy("sample", "kind")), "share"))


@query(sql("c AS (SELECT category, event_type, count(*) FILTER (label = 1) + 1 AS a, count(*) FILTER (label = 0) + 1 AS b FROM evt GROUP BY ALL), s AS (SELECT category, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c) SELECT category, round(sum(p * ln(p / q)), 6) AS kl, round(sum(greatest(p * ln(p / q), 0)), 6) AS up, round(sum(least(p * ln(p / q), 0)), 6) AS down, round(sum(abs(p - q)) / 2, 6) AS variation, round(sum(p), 6) AS mass FROM s GROUP BY category", "evt"))
def e19_distribution_change(spark, d):
    """Signed divergence per category between the item shares of two outcomes, one added to each count."""
    side = lambda y: F.count(F.when(F.col("label") == y, 1)) + 1
    c = fx.evt(spark, d).groupBy("category", "event_type").agg(side(1).alias("a"), side(0).alias("b"))
    whole = F.broadcast(c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))  # one row
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    term, zero = p * F.log(p / q), F.lit(0.0)
    return c.join(whole).groupBy("category").agg(r6(F.sum(term), "kl"), r6(F.sum(F.greatest(term, zero)), "up"), r6(F.sum(F.least(term, zero)), "down"), r6(F.sum(F.abs(p - q)) / 2, "variation"), r6(F.sum(p), "mass"))


@query("WITH l AS (SELECT vec_id AS row_id, list_transform(embedding, lambda v: v::DOUBLE * 10) AS z FROM embeddings), m AS (SELECT row_id, z, list_max(z) AS top, list_reverse_sort(z)[2] AS second, ln(list_sum(list_transform(z, lambda v: exp(v)))) AS lse FROM l) SELECT row_id, round(lse - list_sum(list_transform(z, lambda v: v * exp(v - lse))), 6) AS entropy, round(top - second, 6) AS margin, round(exp(top - lse), 6) AS top_probability, (list_position(z, top) - 1)::INT AS argmax FROM m")
def e20_logit_scalars(spark, d):
    add = lambda z, f: F.aggregate(z, F.lit(0.0), lambda t, v: t + f(v))
    z, top, lse = map(F.col, ("z", "top", "lse"))
    m = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double") * 10).alias("z"))
    m = m.select("row_id", "z", F.array_max("z").alias("top"), F.element_at(F.sort_array("z", asc=False), 2).alias("second"), F.log(add(z, F.exp)).alias("lse"))
    return m.select("row_id", r6(lse - add(z, lambda v: v * F.exp(v - lse)), "entropy"), r6(top - F.col("second"), "margin"), r6(F.exp(top - lse), "top_probability"), (F.array_position(z, top) - 1).cast("int").alias("argmax"))


@query(f"WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_totalprice::DOUBLE AS v FROM orders), t AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM o WHERE {uniform_sql('bins', 'id')} < 0.5), e AS (SELECT min(v) FILTER (4 * i >= n) AS e1, min(v) FILTER (4 * i >= 2 * n) AS e2, min(v) FILTER (4 * i >= 3 * n) AS e3 FROM t), b AS (SELECT id, s, (v >= e1)::INT + (v >= e2)::INT + (v >= e3)::INT AS bin FROM o, e) SELECT id, bin, dense_rank() OVER (ORDER BY s, bin)::INT AS stratum FROM b")
def e21_quantile_bins(spark, d):
    """Quartile edges of the training half, counted over value ranges; bins of all rows and
    a code of bin and status."""
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").cast("double").alias("v"))
    train = o.where(uniform("bins", F.col("id")) < 0.5).groupBy("v").agg(F.count("*").alias("c"))
    placed = running(train, [], "v", {"upto": "c"}).join(F.broadcast(train.agg(F.sum("c").alias("n"))))  # one row
    edges = F.broadcast(placed.agg(*(F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("v"))).alias(f"e{k}") for k in (1, 2, 3))))  # one row
    bins = o.join(edges).select("id", "s", sum(((F.col("v") >= F.col(f"e{k}")).cast("int") for k in (1, 2, 3)), F.lit(0)).alias("bin"))
    codes = bins.select("s", "bin").distinct().withColumn("stratum", F.row_number().over(Window.orderBy("s", "bin")))  # over the vocabulary
    return bins.join(codes, ["s", "bin"]).select("id", "bin", "stratum")


@query("WITH g AS (SELECT l_linenumber::INT AS layer, l_extendedprice::DOUBLE AS v, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL), o AS (SELECT *, sum(w) OVER (PARTITION BY layer ORDER BY v) AS c, sum(w) OVER (PARTITION BY layer) AS t FROM g) SELECT layer, min(v) FILTER (2 * c >= t) AS median, min(v) FILTER (10 * c >= 9 * t) AS upper, round(sum(v * w) / sum(w), 4) AS mean FROM o GROUP BY layer")
def g08_weighted_quantiles(spark, d):
    """Inverse weighted distribution without interpolation; weights are summed over value ranges."""
    g = fx.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("layer"), F.col("l_extendedprice").cast("double").alias("v")).agg(F.sum("l_quantity").cast("double").alias("w"))
    o = running(g, ["layer"], "v", {"c": "w"}).join(g.groupBy("layer").agg(F.sum("w").alias("t")), "layer")
    v, w, c, t = map(F.col, ("v", "w", "c", "t"))
    return o.groupBy("layer").agg(F.min(F.when(2 * c >= t, v)).alias("median"), F.min(F.when(10 * c >= 9 * t, v)).alias("upper"), F.round(F.sum(v * w) / F.sum(w), 4).alias("mean"))
