"""Queries over trajectories and information (J, I)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from layerroutes.functions.arrays import signed_round
from layerroutes.functions.hashing import uniform
from layerroutes.functions.stats import adjusted_information, entropy_bits, quantiles, rand_index, wilson
from layerroutes.operators import routes as R
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql, uniform_sql
from layerroutes.plans.registry import query

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)

STEPS = "steps AS (SELECT * FROM (SELECT row_id, layer AS layer_from, lead(layer) OVER w AS layer_to, state AS state_from, lead(state) OVER w AS state_to, label FROM rt WINDOW w AS (PARTITION BY row_id ORDER BY layer)) WHERE layer_to IS NOT NULL)"
EDGES = STEPS + ", edges AS (SELECT layer_from, layer_to, state_from, state_to, count(*) AS n, avg(label) AS label_mean FROM steps GROUP BY ALL)"


@query(sql("SELECT row_id, layer, CASE WHEN state = 3 THEN -1 ELSE state * 10 END AS state FROM routes", "routes"))
def j01_global_labels(spark, d):
    local = fx.routes(spark, d).withColumnRenamed("state", "local_state")
    vocab = fx.centers(spark, d).where("state <> 3").select("layer", F.col("state").alias("local_state"), (F.col("state") * 10).alias("state"))
    return R.to_global(local, vocab).select("row_id", "layer", "state")


@query(sql(EDGES + " SELECT layer_from, layer_to, state_from, state_to, n FROM edges", "rt"))
def j02_transitions(spark, d):
    return R.transitions(fx.rt(spark, d))


@query(sql(EDGES + """, i AS (SELECT layer_from, layer_from + 1 AS layer, state_to AS state, sum(n)::BIGINT AS n FROM edges GROUP BY ALL),
 o AS (SELECT layer_from, layer_from AS layer, state_from AS state, sum(n)::BIGINT AS n FROM edges GROUP BY ALL)
SELECT 'birth' AS kind, layer, state, n FROM i WHERE (layer_from, state) NOT IN (SELECT (layer_from, state) FROM o) AND n >= 3
UNION ALL SELECT 'death', layer, state, n FROM o WHERE (layer_from, state) NOT IN (SELECT (layer_from, state) FROM i) AND n >= 3""", "rt"))
def j03_births_deaths(spark, d):
    return R.births_deaths(R.transitions(fx.rt(spark, d)), 3)


@query(sql(EDGES + """, p AS (SELECT *, n / sum(n) OVER w AS prob, sum(n) OVER w AS total FROM edges WINDOW w AS (PARTITION BY layer_from, state_from)),
 q AS (SELECT *, n / sum(n) OVER w AS prob, sum(n) OVER w AS total FROM edges WINDOW w AS (PARTITION BY layer_from, state_to))
SELECT 'split' AS kind, layer_from AS layer, state_from AS state, count(*) AS branches, string_agg(state_to::VARCHAR, ',' ORDER BY state_to) AS targets, round(max(prob), 6) AS max_prob FROM p WHERE prob >= 0.05 AND total >= 20 GROUP BY ALL HAVING count(*) >= 2
UNION ALL SELECT 'merge', layer_from + 1, state_to, count(*), string_agg(state_from::VARCHAR, ',' ORDER BY state_from), round(max(prob), 6) FROM q WHERE prob >= 0.05 AND total >= 20 GROUP BY ALL HAVING count(*) >= 2""", "rt"))
def j04_splits_merges(spark, d):
    return R.splits_merges(R.transitions(fx.rt(spark, d))).select("kind", "layer", "state", "branches", "targets", r6("max_prob"))


@query(sql(f"s AS (SELECT row_id FROM emb ORDER BY {uniform_sql('hamming', 'row_id')}, row_id LIMIT 60), r AS (SELECT * FROM routes WHERE row_id IN (SELECT row_id FROM s)) SELECT a.row_id, b.row_id AS other, round(count(*) / 8, 6) AS similarity FROM r a JOIN r b ON a.layer = b.layer AND a.state = b.state AND a.row_id < b.row_id GROUP BY ALL", "routes", "emb"))
def j05_hamming(spark, d):
    sample = fx.emb(spark, d).orderBy(uniform("hamming", F.col("row_id")), "row_id").limit(60)
    return R.hamming(fx.routes(spark, d), sample).withColumn("similarity", F.round("similarity", 6))


@query(sql(STEPS + ", a AS (SELECT layer, count(DISTINCT state) AS active FROM rt GROUP BY layer) SELECT layer_from, round(avg((state_from = state_to)::INT), 6) AS self_prob, max(active) AS active FROM steps JOIN a ON layer = layer_from GROUP BY layer_from", "rt"))
def j06_self_transition(spark, d):
    rt = fx.rt(spark, d)
    active = rt.groupBy(F.col("layer").alias("layer_from")).agg(F.countDistinct("state").alias("active"))
    p = R.steps(rt).groupBy("layer_from").agg(F.avg((F.col("state_from") == F.col("state_to")).cast("int")).alias("p"))
    return p.join(active, "layer_from").select("layer_from", r6("p", "self_prob"), "active")


@query(sql(EDGES + """, o AS (SELECT layer_from AS layer, state_from AS state, sum(-p * log2(p)) AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY layer_from, state_from) AS p FROM edges) GROUP BY ALL),
 n AS (SELECT layer, state, count(*) AS n, avg(label) AS m FROM rt GROUP BY ALL)
SELECT n.layer, n.state, n, round(n / sum(n) OVER w, 6) AS freq, round(row_number() OVER (PARTITION BY n.layer ORDER BY n DESC, n.state) - (count(*) OVER w + 1) / 2, 6) AS rank, round(coalesce(h, 0), 6) AS out_entropy, round(m, 6) AS label_mean, round(m - (SELECT avg(label) FROM rt), 6) AS delta
FROM n LEFT JOIN o USING (layer, state) WINDOW w AS (PARTITION BY n.layer)""", "rt"))
def j07_nodes(spark, d):
    return R.nodes(fx.rt(spark, d)).select("layer", "state", "n", *(r6(c) for c in ("freq", "rank", "out_entropy", "label_mean", "delta")))


@query(sql(EDGES + " SELECT layer_from, layer_to, state_from, state_to, n, round(n / sum(n) OVER (PARTITION BY layer_from, state_from), 6) AS prob, round(n / sum(n) OVER (PARTITION BY layer_from), 6) AS freq, round(label_mean, 6) AS label_mean, round(label_mean - (SELECT avg(label) FROM rt), 6) AS delta FROM edges", "rt"))
def j08_edges(spark, d):
    return R.edges_with_label(fx.rt(spark, d)).select(*R.EDGE, "n", *(r6(c) for c in ("prob", "freq", "label_mean", "delta")))


@query(sql(EDGES + ", p AS (SELECT layer_from, state_from, n / sum(n) OVER (PARTITION BY layer_from, state_from) AS p FROM edges), h AS (SELECT layer_from AS layer, state_from AS state, -sum(p * ln(p + 1e-15)) AS h FROM p GROUP BY ALL) SELECT layer, state, count(*) AS n, round(coalesce(max(h), 0), 6) AS out_entropy FROM rt LEFT JOIN h USING (layer, state) GROUP BY ALL", "rt"))
def j09_out_entropy_nats(spark, d):
    rt = fx.rt(spark, d)
    p = R.with_share(R.transitions(rt), ["layer_from", "state_from"])
    h = p.groupBy(F.col("layer_from").alias("layer"), F.col("state_from").alias("state")).agg((-F.sum(F.col("prob") * F.log(F.col("prob") + 1e-15))).alias("h"))
    n = rt.groupBy("layer", "state").agg(F.count("*").alias("n"))
    return n.join(h, ["layer", "state"], "left").select("layer", "state", "n", F.round(F.coalesce("h", F.lit(0.0)), 6).alias("out_entropy"))


@query(sql("n AS (SELECT state, count(*) AS n FROM routes GROUP BY state) SELECT state, n, row_number() OVER (ORDER BY n DESC, state) AS rank, round(sum(n) OVER (ORDER BY n DESC, state) / (SELECT sum(n) FROM n), 6) AS cumulative FROM n", "routes"))
def j10_marginals(spark, d):
    n = fx.routes(spark, d).groupBy("state").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "state")  # over the vocabulary
    return n.select("state", "n", F.row_number().over(w).alias("rank"), F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 6).alias("cumulative"))


@query(sql("v AS (SELECT DISTINCT layer, state FROM routes), k AS (SELECT layer, count(*) AS active FROM v GROUP BY layer), i AS (SELECT a.layer, count(*) AS kept FROM v a JOIN v b ON a.state = b.state AND b.layer = a.layer - 1 GROUP BY a.layer) SELECT layer, round(layer / 7, 6) AS depth, active, round(1 / active, 6) AS uniform_self, round(coalesce(kept, 0) / active, 6) AS inherited FROM k LEFT JOIN i USING (layer)", "routes"))
def j11_layer_profile(spark, d):
    v = fx.routes(spark, d).select("layer", "state").distinct()
    active = v.groupBy("layer").agg(F.count("*").alias("active"))
    kept = v.join(v.select((F.col("layer") + 1).alias("layer"), "state"), ["layer", "state"]).groupBy("layer").agg(F.count("*").alias("kept"))
    return active.join(kept, "layer", "left").select("layer", F.round(F.col("layer") / (fx.LAYERS - 1), 6).alias("depth"), "active", F.round(1 / F.col("active"), 6).alias("uniform_self"), F.round(F.coalesce("kept", F.lit(0)) / F.col("active"), 6).alias("inherited"))


@query(sql("SELECT layer, " + ", ".join(f"round(avg(label) FILTER (state = {s}), 6) AS rate_{s}, nullif(count(*) FILTER (state = {s}), 0) AS n_{s}" for s in range(6)) + " FROM rt GROUP BY layer", "rt"))
def j12_matrices(spark, d):
    g = fx.rt(spark, d).groupBy("layer").pivot("state", list(range(6))).agg(F.round(F.avg("label"), 6).alias("rate"), F.count(F.lit(1)).alias("n"))
    return g.select("layer", *(F.col(f"{s}_{c}").alias(f"{c}_{s}") if c == "rate" else F.when(F.col(f"{s}_n") > 0, F.col(f"{s}_n")).alias(f"n_{s}") for s in range(6) for c in ("rate", "n")))


@query(sql("SELECT layer, " + ", ".join(f"round(avg(label) FILTER (state = {s}) - (SELECT avg(label) FROM rt), 6) AS delta_{s}" for s in range(6)) + " FROM rt GROUP BY layer", "rt"))
def j12_deltas(spark, d):
    """Layer by state matrix of the rates less the rate of all rows."""
    rt = fx.rt(spark, d)
    g = rt.groupBy("layer").pivot("state", list(range(6))).agg(F.avg("label")).join(F.broadcast(rt.agg(F.avg("label").alias("base"))))  # one row
    return g.select("layer", *(F.round(F.col(str(s)) - F.col("base"), 6).alias(f"delta_{s}") for s in range(6)))


@query(sql("SELECT state, min(layer) AS first, max(layer) AS last, count(*) AS n, round(avg(label) - (SELECT avg(label) FROM rt), 6) AS delta, count(DISTINCT layer) >= 6 AND count(*) >= 50 AS sink FROM rt GROUP BY state", "rt"))
def j13_life_span(spark, d):
    rt = fx.rt(spark, d)
    g = rt.groupBy("state").agg(F.min("layer").alias("first"), F.max("layer").alias("last"), F.count("*").alias("n"), F.avg("label").alias("m"), F.countDistinct("layer").alias("k"))
    return g.join(rt.agg(F.avg("label").alias("b"))).select("state", "first", "last", "n", F.round(F.col("m") - F.col("b"), 6).alias("delta"), ((F.col("k") >= 6) & (F.col("n") >= 50)).alias("sink"))


@query(sql(STEPS + ", g AS (SELECT coalesce(label::VARCHAR, 'all') AS grp, layer_from, state_from, state_to, count(*) AS n FROM steps GROUP BY GROUPING SETS ((layer_from, state_from, state_to), (label, layer_from, state_from, state_to))) SELECT grp, layer_from, state_from, state_to, n, round(n / sum(n) OVER (PARTITION BY grp, layer_from, state_from), 6) AS prob FROM g", "rt"))
def j14_class_transitions(spark, d):
    s = R.steps(fx.rt(spark, d), "label")
    sets = s.groupingSets([["layer_from", "state_from", "state_to"], ["label", "layer_from", "state_from", "state_to"]], "label", "layer_from", "state_from", "state_to").agg(F.count("*").alias("n"))
    g = sets.select(F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("grp"), "layer_from", "state_from", "state_to", "n")
    return R.with_share(g, ["grp", "layer_from", "state_from"]).withColumn("prob", F.round("prob", 6))


@query(sql("c AS (SELECT layer, state, category, count(*) AS n FROM rt GROUP BY ALL), t AS (SELECT layer, state, arg_max(category, (n, category)) AS top, max(n) / sum(n) AS share FROM c GROUP BY ALL), a AS (SELECT layer, state, avg(label) - (SELECT avg(label) FROM rt) AS delta FROM rt GROUP BY ALL) SELECT layer, state, top, round(share, 6) AS share, CASE WHEN share > 0.6 THEN 'single' ELSE 'mixed' END AS kind, CASE WHEN delta >= 0.3 THEN 'good' WHEN delta <= -0.3 THEN 'bad' ELSE 'neutral' END AS tag FROM t JOIN a USING (layer, state)", "rt"))
def j15_state_tags(spark, d):
    rt = fx.rt(spark, d)
    c = rt.groupBy("layer", "state", "category").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    t = c.groupBy("layer", "state").agg(F.max_by("category", F.struct("n", "category")).alias("top"), (F.max("n") / F.sum("n")).alias("share"), (F.sum("y") / F.sum("n")).alias("m"))
    delta = F.col("m") - F.col("b")
    return t.join(rt.agg(F.avg("label").alias("b"))).select("layer", "state", "top", r6("share"), F.when(F.col("share") > 0.6, "single").otherwise("mixed").alias("kind"), F.when(delta >= 0.3, "good").when(delta <= -0.3, "bad").otherwise("neutral").alias("tag"))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT x.a, y.b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e, sum(n) OVER () AS t FROM g)
SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::BIGINT AS dof, round(sqrt(sum((n - e) * (n - e) / e) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v, round(min(e), 6) AS min_expected, round(avg((e < 5)::INT), 6) AS share_under_5, max(t)::BIGINT AS n FROM e""")
def j16_association(spark, d):
    a = R.association(fx.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return a.select(r6("chi2"), "dof", r6("cramers_v"), r6("min_expected"), r6("share_under_5"), "n")


@query(sql("SELECT layer, state, count(*) AS n, round(avg(label), 6) AS accuracy, round(avg(label) - (SELECT avg(label) FROM rt), 6) AS delta, round(avg(n_tokens), 6) AS mean_tokens, round(quantile_cont(n_tokens, 0.5), 6) AS median_tokens, round(avg((finish_reason = 'length')::INT), 6) AS truncated, round(avg(label) FILTER (finish_reason <> 'length'), 6) AS clean_accuracy FROM rt GROUP BY ALL", "rt"))
def j17_state_outcomes(spark, d):
    rt = fx.rt(spark, d)
    cut = F.col("finish_reason") == "length"
    g = rt.groupBy("layer", "state").agg(F.count("*").alias("n"), F.avg("label").alias("m"), r6(F.avg("n_tokens"), "mean_tokens"), r6(F.percentile("n_tokens", F.lit(0.5)), "median_tokens"), r6(F.avg(cut.cast("int")), "truncated"), r6(F.avg(F.when(~cut, F.col("label"))), "clean_accuracy"))
    return g.join(rt.agg(F.avg("label").alias("b"))).select("layer", "state", "n", r6("m", "accuracy"), r6(F.col("m") - F.col("b"), "delta"), "mean_tokens", "median_tokens", "truncated", "clean_accuracy")


@query(sql(STEPS + " SELECT layer_from, state_from, state_to, count(*) AS n, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg, round(avg(label), 6) AS rate, count(*) >= 30 AND sum(label) >= 10 AND count(*) - sum(label) >= 10 AS shown FROM steps GROUP BY ALL", "rt"))
def j18_edge_contrast(spark, d):
    g = R.steps(fx.rt(spark, d), "label").groupBy("layer_from", "state_from", "state_to").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"), r6(F.avg("label"), "rate"))
    neg = F.col("n") - F.col("pos")
    return g.withColumns({"neg": neg, "shown": (F.col("n") >= 30) & (F.col("pos") >= 10) & (neg >= 10)})


@query(sql(EDGES + """, p AS (SELECT *, n / sum(n) OVER w AS prob, count(*) OVER w AS deg, row_number() OVER (PARTITION BY layer_from, state_from ORDER BY n DESC, state_to) AS rank FROM edges WINDOW w AS (PARTITION BY layer_from, state_from)),
 h AS (SELECT layer_from, state_from, sum(-prob * log2(prob)) / nullif(log2(max(deg)), 0) AS h FROM p GROUP BY ALL) SELECT layer_from, state_from, state_to, n, round(prob, 6) AS prob, round(coalesce(h, 0), 6) AS norm_entropy FROM p JOIN h USING (layer_from, state_from) WHERE n >= 5 AND prob >= 0.1 AND rank <= 3""", "rt"))
def j19_display_filter(spark, d):
    by = ["layer_from", "state_from"]
    p = R.with_share(R.transitions(fx.rt(spark, d)), by)
    p = p.withColumns({"deg": F.count("*").over(Window.partitionBy(*by)), "rank": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "state_to"))})
    h = p.groupBy(*by).agg((F.sum(entropy_bits(F.col("prob"))) / F.nullif(F.log2(F.max("deg")), F.lit(0.0))).alias("h"))
    return p.join(h, by).where("n >= 5 and prob >= 0.1 and rank <= 3").select(*by, "state_to", "n", r6("prob"), r6(F.coalesce("h", F.lit(0.0)), "norm_entropy"))


@query(sql("c AS (SELECT state, layer, count(*) AS n FROM routes GROUP BY ALL) SELECT state, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY state", "routes"))
def j20_purity(spark, d):
    c = fx.routes(spark, d).groupBy("state", "layer").agg(F.count("*").alias("n"))
    return c.groupBy("state").agg(r6(F.max("n") / F.sum("n"), "purity"))


@query(r"""WITH x AS (SELECT l_returnflag AS grp, year(l_shipdate) AS yr, l_linestatus AS cat, (l_quantity > 25)::INT AS y, l_extendedprice::DOUBLE AS v FROM lineitem), e AS (SELECT *, avg(y) OVER (PARTITION BY cat, yr) AS expected FROM x),
g AS (SELECT grp, yr, count(*) AS n, avg(y) AS p, avg(expected) AS e, quantile_cont(v, 0.5) AS q FROM e GROUP BY ALL)
SELECT grp, yr, n, round(p, 6) AS rate, round(e, 6) AS expected, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high, round(q, 4) AS median FROM g""")
def j21_adjusted_profile(spark, d):
    x = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.year("l_shipdate").cast("long").alias("yr"), F.col("l_linestatus").alias("cat"), (F.col("l_quantity") > 25).cast("int").alias("y"), F.col("l_extendedprice").cast("double").alias("v"))
    e = x.groupBy("cat", "yr").agg(F.avg("y").alias("expected"))  # a row per stratum, joined instead of a window over rows
    g = x.join(e, ["cat", "yr"]).groupBy("grp", "yr").agg(F.count("*").alias("n"), F.avg("y").alias("p"), F.avg("expected").alias("e"))
    g = g.join(quantiles(x, ["grp", "yr"], "v", [0.5]).withColumnRenamed("q0", "q"), ["grp", "yr"])
    low, high = wilson(F.col("p"), F.col("n"))
    return g.select("grp", "yr", "n", r6("p", "rate"), r6("e", "expected"), r6(low, "low"), r6(high, "high"), F.round("q", 4).alias("median"))


@query(sql("o AS (SELECT sample, event_type AS state, count(*) / max(n_tokens) AS w, max(label) AS y, max(n_tokens) AS len FROM evt GROUP BY ALL) SELECT state, round(sum(w), 6) AS weight, round(sum(w * y) / sum(w), 6) AS label_rate, round(sum(w * len) / sum(w), 6) AS mean_length FROM o GROUP BY state", "evt"))
def j22_weighted_profile(spark, d):
    o = fx.evt(spark, d).groupBy("sample", F.col("event_type").alias("state")).agg((F.count("*") / F.max("n_tokens")).alias("w"), F.max("label").alias("y"), F.max("n_tokens").alias("len"))
    w = F.sum("w")
    return o.groupBy("state").agg(r6(w, "weight"), r6(F.sum(F.col("w") * F.col("y")) / w, "label_rate"), r6(F.sum(F.col("w") * F.col("len")) / w, "mean_length"))


@query(sql("o AS (SELECT sample, event_type AS state, count(*) / max(n_tokens) AS w FROM evt GROUP BY ALL), m AS (SELECT sample, avg(entropy) AS e FROM evt GROUP BY sample) SELECT state, round(sum(w * e) / sum(w), 6) AS mean_entropy FROM o JOIN m USING (sample) GROUP BY state", "evt"))
def j22_weighted_entropy(spark, d):
    """Mean entropy of the samples, weighted by how much of each a state takes."""
    e = fx.evt(spark, d)
    o = e.groupBy("sample", F.col("event_type").alias("state")).agg((F.count("*") / F.max("n_tokens")).alias("w"))
    o = o.join(e.groupBy("sample").agg(F.avg("entropy").alias("e")), "sample")
    return o.groupBy("state").agg(r6(F.sum(F.col("w") * F.col("e")) / F.sum("w"), "mean_entropy"))


H = "sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END)"


@query(sql(f"c AS (SELECT layer, state, label, count(*) AS n FROM rt GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY layer) AS p FROM c), s AS (SELECT layer, {H} AS hs FROM (SELECT layer, state, sum(p) AS p FROM t GROUP BY ALL) GROUP BY layer), y AS (SELECT layer, {H} AS hy FROM (SELECT layer, label, sum(p) AS p FROM t GROUP BY ALL) GROUP BY layer), j AS (SELECT layer, {H} AS hj FROM t GROUP BY layer) SELECT layer, round(hs, 6) AS state_bits, round(hy, 6) AS label_bits, round(hs + hy - hj, 6) AS mutual_bits FROM s JOIN y USING (layer) JOIN j USING (layer)", "rt"))
def i01_information(spark, d):
    c = fx.rt(spark, d).groupBy("layer", "state", "label").agg(F.count("*").alias("n"))
    t = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("layer")))
    h = lambda by, name: t.groupBy("layer", *by).agg(F.sum("p").alias("p")).groupBy("layer").agg(F.sum(entropy_bits(F.col("p"))).alias(name))
    j = h(["state"], "hs").join(h(["label"], "hy"), "layer").join(h(["state", "label"], "hj"), "layer")
    return j.select("layer", r6("hs", "state_bits"), r6("hy", "label_bits"), r6(F.col("hs") + F.col("hy") - F.col("hj"), "mutual_bits"))


@query(sql("c AS (SELECT label, event_type, count(*) / sum(count(*)) OVER (PARTITION BY label) AS p FROM evt GROUP BY label, event_type), m AS (SELECT event_type, coalesce(max(p) FILTER (label = 0), 0) AS p, coalesce(max(p) FILTER (label = 1), 0) AS q FROM c GROUP BY event_type) SELECT round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / (2 * ln(2)), 9) AS js_bits FROM m", "evt"))
def i02_jensen_shannon(spark, d):
    c = fx.evt(spark, d).groupBy("label", "event_type").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    side = lambda y, n: c.where(F.col("label") == y).select("event_type", F.col("p").alias(n))
    m = side(0, "p").join(side(1, "q"), "event_type", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    part = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log(2 * F.col(a) / (F.col("p") + F.col("q")))).otherwise(0.0)
    return m.agg(F.round(F.sum(part("p") + part("q")) / (2 * F.log(F.lit(2.0))), 9).alias("js_bits"))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL), r AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c * ln(c)) AS l FROM (SELECT sum(c) AS c FROM c GROUP BY a)), k AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c * ln(c)) AS l FROM (SELECT sum(c) AS c FROM c GROUP BY b)), t AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n, sum(c * ln(c)) AS l FROM c)
SELECT round((t.s - r.s * k.s / (n * (n - 1) / 2)) / ((r.s + k.s) / 2 - r.s * k.s / (n * (n - 1) / 2)), 9) AS ari, round(2 * ((ln(n) - r.l / n) + (ln(n) - k.l / n) - (ln(n) - t.l / n)) / ((ln(n) - r.l / n) + (ln(n) - k.l / n)), 9) AS nmi FROM t, r, k""")
def i04_agreement(spark, d):
    out = rand_index(fx.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select(F.round("ari", 9).alias("ari"), F.round("nmi", 9).alias("nmi"))


_AMI = """c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS m FROM lineitem GROUP BY ALL), l AS (SELECT a, sum(m)::BIGINT AS x FROM c GROUP BY a), r AS (SELECT b, sum(m)::BIGINT AS y FROM c GROUP BY b), t AS (SELECT sum(m)::BIGINT AS n FROM c),
 mi AS (SELECT sum(m / n * ln(n * m / (x * y))) AS mi FROM c JOIN l USING (a) JOIN r USING (b), t), h AS (SELECT (SELECT -sum(x / n * ln(x / n)) FROM l, t) AS ha, (SELECT -sum(y / n * ln(y / n)) FROM r, t) AS hb),
 k AS (SELECT x, y, n, unnest(range(greatest(1, x + y - n)::BIGINT, least(x, y)::BIGINT + 1)) AS k FROM l, r, t),
 e AS (SELECT sum(k / n * ln(n * k / (x * y)) * exp(lgamma(y + 1) - lgamma(k + 1) - lgamma(y - k + 1) + lgamma(n - y + 1) - lgamma(x - k + 1) - lgamma(n - y - x + k + 1) - lgamma(n + 1) + lgamma(x + 1) + lgamma(n - x + 1))) AS e FROM k)
SELECT round(mi, 7) AS mi, round(e, 7) AS expected, round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM mi, h, e"""


@query("WITH " + _AMI)
def i04_adjusted_information(spark, d):
    """Mutual information adjusted for chance."""
    out = adjusted_information(fx.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select(F.round("mi", 7).alias("mi"), F.round("expected", 7).alias("expected"), signed_round(F.col("ami")).alias("ami"))


@query(sql("e AS (SELECT r.layer, r.state, i, s.x[i] AS v FROM routes r JOIN states s USING (row_id, layer), range(1, 9) t(i)), g AS (SELECT layer, state, i, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL), t AS (SELECT layer, i, avg(v) AS gm, sum(v * v) - count(*) * avg(v) * avg(v) AS total, count(*) AS n FROM e GROUP BY ALL), b AS (SELECT g.layer, sum(g.n * (m - gm) * (m - gm)) AS b, count(DISTINCT state) AS k FROM g JOIN t USING (layer, i) GROUP BY g.layer) SELECT b.layer, round(b / sum(total), 6) AS between_share, round((k - 1) / (max(n) - 1), 6) AS chance_share FROM b JOIN t USING (layer) GROUP BY b.layer, b, k", "routes"))
def i05_anova(spark, d):
    e = fx.routes(spark, d).join(fx.states(spark, d), ["row_id", "layer"]).select("layer", "state", F.posexplode("x").alias("i", "v"))
    g = e.groupBy("layer", "state", "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    t = g.groupBy("layer", "i").agg(F.sum("n").alias("tn"), (F.sum("s") / F.sum("n")).alias("gm"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("total"))
    b = g.join(t.select("layer", "i", "gm"), ["layer", "i"]).groupBy("layer").agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("gm")) ** 2).alias("b"), F.countDistinct("state").alias("k"))
    return t.groupBy("layer").agg(F.sum("total").alias("total"), F.max("tn").alias("n")).join(b, "layer").select("layer", r6(F.col("b") / F.col("total"), "between_share"), r6((F.col("k") - 1) / (F.col("n") - 1), "chance_share"))


@query(sql("e AS (SELECT r.layer, r.state, i, s.x[i] AS v FROM routes r JOIN states s USING (row_id, layer), range(1, 9) t(i)), w AS (SELECT layer, state, i, count(*) AS n, var_pop(v) AS v FROM e GROUP BY ALL), a AS (SELECT layer, sum(v) AS total FROM (SELECT layer, i, var_pop(v) AS v FROM e GROUP BY ALL) GROUP BY layer), b AS (SELECT layer, sum(n * v) / (sum(n) / 8) AS within FROM w GROUP BY layer), p AS (SELECT layer, n / sum(n) OVER (PARTITION BY layer) AS p FROM (SELECT layer, state, count(*) AS n FROM routes GROUP BY ALL)), h AS (SELECT layer, -sum(p * ln(p)) AS h FROM p GROUP BY layer) SELECT layer, round(within, 6) AS within, round(total - within, 6) AS between, round(h, 6) AS entropy FROM a JOIN b USING (layer) JOIN h USING (layer)", "routes"))
def i05_partition(spark, d):
    """Variance within and between states, summed over coordinates, and entropy of occupancy."""
    e = fx.routes(spark, d).join(fx.states(spark, d), ["row_id", "layer"]).select("layer", "state", F.posexplode("x").alias("i", "v"))
    g = e.groupBy("layer", "state", "i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("v"))
    n, m = F.col("n"), F.col("m")
    t = g.groupBy("layer", "i").agg((F.sum(n * F.col("v")) / F.sum(n)).alias("w"), (F.sum(n * m * m) / F.sum(n) - F.pow(F.sum(n * m) / F.sum(n), 2)).alias("b"))
    occupied = g.where("i = 0").groupBy("layer").agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("entropy"))
    return t.groupBy("layer").agg(r6(F.sum("w"), "within"), r6(F.sum("b"), "between")).join(occupied, "layer").select("layer", "within", "between", r6("entropy"))
