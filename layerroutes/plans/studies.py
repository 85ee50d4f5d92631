"""Queries of label models, route models, nulls, cluster quality and geometry studies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.functions.hashing import POISSON, poisson, uniform
from layerroutes.functions.stats import auroc, running, wilson
from layerroutes.operators import bayes, distances, nulls
from layerroutes.operators import routes as R
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql, uniform_sql
from layerroutes.plans.registry import query
from layerroutes.plans.vectors import JOINT, model

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
STEP = "stp AS (SELECT * FROM (SELECT row_id, label, level, layer, lead(layer) OVER w AS nxt, state AS i, lead(state) OVER w AS j FROM rt WINDOW w AS (PARTITION BY row_id ORDER BY layer)) WHERE nxt IS NOT NULL)"
ODDS = "ln((coalesce(c1, 0) + 1) / (coalesce(n1, 0) + size)) - ln((coalesce(c0, 0) + 1) / (coalesce(n0, 0) + size))"
TWO = "count(*) FILTER (label = 1) AS {0}1, count(*) FILTER (label = 0) AS {0}0"
TRAIN = "tr AS (SELECT * FROM rt WHERE row_id % 5 <> 0), te AS (SELECT * FROM rt WHERE row_id % 5 = 0), pr AS (SELECT count(*) FILTER (label = 1) AS p1, count(*) FILTER (label = 0) AS p0 FROM emb WHERE row_id % 5 <> 0)"


def train_test(spark, d):
    rt = fx.rt(spark, d)
    return rt.where("row_id % 5 <> 0"), rt.where("row_id % 5 = 0")


@query(sql(TRAIN + f", s AS (SELECT max(state) + 1 AS size FROM tr), n AS (SELECT layer, {TWO.format('n')} FROM tr GROUP BY layer), c AS (SELECT layer, state, {TWO.format('c')} FROM tr GROUP BY ALL) SELECT row_id, round(ln((max(p1) + 1) / (max(p0) + 1)) + sum({ODDS}), 6) AS log_odds FROM te JOIN n USING (layer) LEFT JOIN c USING (layer, state), s, pr WHERE state < size GROUP BY row_id", "rt"))
def l02_global_bayes(spark, d):
    return bayes.states(*train_test(spark, d)).select("row_id", r6("log_odds"))


def _markov_sql(size: str, alpha: int) -> str:
    first = f"n AS (SELECT {TWO.format('n')} FROM tr WHERE layer = 0), c AS (SELECT state, {TWO.format('c')} FROM tr WHERE layer = 0 GROUP BY state), a AS (SELECT row_id, {ODDS} AS w FROM te LEFT JOIN c USING (state), n, z WHERE layer = 0 AND z.l = 0)"
    walk = f"es AS (SELECT * FROM stp WHERE row_id % 5 <> 0), en AS (SELECT layer, i, {TWO.format('n')} FROM es GROUP BY ALL), ec AS (SELECT layer, i, j, {TWO.format('c')} FROM es GROUP BY ALL), b AS (SELECT row_id, {ODDS} AS w FROM stp s JOIN z ON z.l = s.nxt LEFT JOIN en ON en.layer = s.layer AND en.i = s.i LEFT JOIN ec ON ec.layer = s.layer AND ec.i = s.i AND ec.j = s.j WHERE row_id % 5 = 0)"
    return sql(f"{TRAIN}, {STEP}, z AS ({size}), {first}, {walk} SELECT row_id, round(ln((max(p1) + {alpha}) / (max(p0) + {alpha})) + sum(w), 6) AS log_odds FROM (SELECT * FROM a UNION ALL SELECT * FROM b), pr GROUP BY row_id", "rt")


@query(_markov_sql("SELECT l, (SELECT max(state) + 1 FROM tr) AS size FROM range(8) t(l)", 1))
def l03_markov_bayes(spark, d):
    train, test = train_test(spark, d)
    size = train.agg((F.max("state") + 1).alias("size"))
    return bayes.markov(train, test, train.select("layer").distinct().join(size)).select("row_id", r6("log_odds"))


@query(_markov_sql("SELECT layer AS l, max(state) + 1 AS size FROM rt GROUP BY layer", 0))
def l04_local_markov(spark, d):
    """Vocabularies of each layer's own size, and the plain prior."""
    train, test = train_test(spark, d)
    sizes = fx.routes(spark, d).groupBy("layer").agg((F.max("state") + 1).alias("size"))
    return bayes.markov(train, test, sizes, prior_alpha=0.0).select("row_id", r6("log_odds"))


@query(sql(TRAIN + ", v AS (SELECT DISTINCT state FROM rt), n AS (SELECT label, state, count(*) AS c FROM tr GROUP BY ALL), lp AS (SELECT y, v.state, ln((coalesce(c, 0) + 1) / (sum(coalesce(c, 0)) OVER (PARTITION BY y) + count(*) OVER (PARTITION BY y))) AS lp FROM (SELECT * FROM v, (SELECT unnest([0, 1]) AS y)) v LEFT JOIN n ON n.label = y AND n.state = v.state) SELECT row_id, round(max(ln(p1 / p0)) + sum(CASE WHEN y = 1 THEN lp ELSE -lp END), 6) AS log_odds FROM te JOIN lp USING (state), pr GROUP BY row_id", "rt"))
def l06_multinomial_bayes(spark, d):
    """Multinomial naive Bayes on how often a row visits each state."""
    train, test = train_test(spark, d)
    vocab = fx.routes(spark, d).select("state").distinct()
    c = vocab.join(train.groupBy("state").agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0")), "state", "left").fillna(0)
    n = c.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.count("*").alias("k"))  # one row
    odds = c.join(n).select("state", (F.log((F.col("c1") + 1) / (F.col("n1") + F.col("k"))) - F.log((F.col("c0") + 1) / (F.col("n0") + F.col("k")))).alias("w"))
    prior = train.where("layer = 0").agg(F.log(F.sum("label") / F.sum(1 - F.col("label"))).alias("prior"))
    return test.join(odds, "state").groupBy("row_id").agg(F.sum("w").alias("w")).join(prior).select("row_id", r6(F.col("w") + F.col("prior"), "log_odds"))


@query(sql(JOINT + ", a AS (SELECT a.row_id, a.layer, a.state AS i, b.state AS j, a.r AS p, b.r AS q FROM resp a JOIN resp b ON a.row_id = b.row_id AND b.layer = a.layer + 1), tc AS (SELECT layer, i, j, sum(p * q) + 1 AS c FROM a WHERE row_id % 5 <> 0 GROUP BY ALL), m AS (SELECT *, c / sum(c) OVER (PARTITION BY layer, i) AS t FROM tc), e AS (SELECT row_id, layer, j, sum(p * t) AS p, max(q) AS q FROM a JOIN m USING (layer, i, j) WHERE row_id % 5 = 0 GROUP BY ALL), s AS (SELECT row_id, layer, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM e GROUP BY ALL) SELECT row_id, round(avg(js), 6) AS soft_js FROM s GROUP BY row_id", "states", "centers"))
def r03_soft_surprise(spark, d):
    """Posteriors sent through the soft transitions of training rows against those observed."""
    j = distances.gaussian_log_joint(fx.states(spark, d), model(spark, d))
    p = distances.responsibilities(j, ["row_id", "layer"]).select("row_id", "layer", "state", "resp")
    nxt = p.select("row_id", (F.col("layer") - 1).alias("layer"), F.col("state").alias("j"), F.col("resp").alias("q"))
    a = p.select("row_id", "layer", F.col("state").alias("i"), F.col("resp").alias("p")).join(nxt, ["row_id", "layer"])
    t = a.where("row_id % 5 <> 0").groupBy("layer", "i", "j").agg((F.sum(F.col("p") * F.col("q")) + 1).alias("c"))
    t = R.with_share(t.withColumnRenamed("c", "n"), ["layer", "i"], "t").drop("n")
    e = a.where("row_id % 5 = 0").join(t, ["layer", "i", "j"]).groupBy("row_id", "layer", "j").agg(F.sum(F.col("p") * F.col("t")).alias("p"), F.max("q").alias("q"))
    return e.groupBy("row_id", "layer").agg(F.sum(nulls.js_bits(F.col("p"), F.col("q"))).alias("js")).groupBy("row_id").agg(r6(F.avg("js"), "soft_js"))


@query(sql("l AS (SELECT row_id, layer, state, lag(state, 1) OVER w AS s1, lag(state, 2) OVER w AS s2 FROM routes WINDOW w AS (PARTITION BY row_id ORDER BY layer)), tr AS (SELECT * FROM l WHERE row_id % 5 <> 0), k AS (SELECT layer, count(DISTINCT state) AS k FROM l GROUP BY layer), n0 AS (SELECT layer, count(*) AS n FROM tr GROUP BY layer), c0 AS (SELECT layer, state, count(*) AS c FROM tr GROUP BY ALL), n1 AS (SELECT layer, s1, count(*) AS n FROM tr GROUP BY ALL), c1 AS (SELECT layer, s1, state, count(*) AS c FROM tr GROUP BY ALL), n2 AS (SELECT layer, s1, s2, count(*) AS n FROM tr GROUP BY ALL), c2 AS (SELECT layer, s1, s2, state, count(*) AS c FROM tr GROUP BY ALL), p0 AS (SELECT l.*, (coalesce(c, 0) + 1) / (n + k) AS p FROM l JOIN k USING (layer) JOIN n0 USING (layer) LEFT JOIN c0 USING (layer, state) WHERE row_id % 5 = 0), p1 AS (SELECT p0.* EXCLUDE p, CASE WHEN s1 IS NULL THEN p ELSE (coalesce(c, 0) + 10 * p) / (coalesce(n, 0) + 10) END AS p FROM p0 LEFT JOIN n1 USING (layer, s1) LEFT JOIN c1 USING (layer, s1, state)), p2 AS (SELECT p1.* EXCLUDE p, CASE WHEN s2 IS NULL THEN p ELSE (coalesce(c, 0) + 10 * p) / (coalesce(n, 0) + 10) END AS p FROM p1 LEFT JOIN n2 USING (layer, s1, s2) LEFT JOIN c2 USING (layer, s1, s2, state)) SELECT row_id, round(avg(-ln(greatest(p, 1e-30))), 6) AS loss FROM p2 GROUP BY row_id", "routes"))
def r04_backoff_markov(spark, d):
    r = fx.routes(spark, d).select("row_id", "layer", "state")
    return bayes.backoff_losses(r.where("row_id % 5 <> 0"), r.where("row_id % 5 = 0")).groupBy("row_id").agg(r6(F.avg("loss"), "loss"))


def _js_sql(src: str, by: str, group: str) -> str:
    """Views that end in ``js(by, js, support)`` of conditional routing over the rows of ``src``."""
    keys = f"{by}, {group}"
    return f"""{src}c AS (SELECT {keys}, j, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM {src} GROUP BY ALL),
 {src}t AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb FROM {src}c WINDOW w AS (PARTITION BY {keys})),
 {src}g AS (SELECT {keys}, max(na + nb) AS w, sum(CASE WHEN a > 0 THEN a / na * log2(2 * (a / na) / (a / na + b / nb)) ELSE 0 END + CASE WHEN b > 0 THEN b / nb * log2(2 * (b / nb) / (a / na + b / nb)) ELSE 0 END) / 2 AS js FROM {src}t WHERE na >= 2 AND nb >= 2 GROUP BY ALL),
 {src}js AS (SELECT {by}, sum(w * js) / sum(w) AS js, sum(w)::BIGINT AS support FROM {src}g GROUP BY {by})"""


def routing(spark, d):
    s = R.steps(fx.rt(spark, d), "label", "level")
    return s.select("row_id", "label", "level", F.col("layer_from").alias("layer"), F.col("state_from").alias("i"), F.col("state_to").alias("dest"))


@query(sql(f"{STEP}, {_js_sql('stp', 'layer', 'i, level')} SELECT layer, round(js, 6) AS js, support FROM stpjs", "rt"))
def n01_stratified_js(spark, d):
    """Origins and a nuisance stratum together."""
    return nulls.conditional_js(routing(spark, d), ["layer"], ["i", "level"]).select("layer", r6("js"), "support")


_PERM = uniform_sql("perm", "rep || '|' || row_id")
PERMUTED = f"{STEP}, o AS (SELECT *, sum(label) OVER (PARTITION BY layer, i, level) AS ones FROM stp), pm AS (SELECT layer, i, level, j, rep, (row_number() OVER (PARTITION BY layer, i, level, rep ORDER BY {_PERM}, row_id) <= ones)::INT AS label FROM o, range(19) t(rep))"


@query(sql(f"{PERMUTED}, {_js_sql('stp', 'layer', 'i, level')}, {_js_sql('pm', 'layer, rep', 'i, level')} SELECT s.layer, round(max(s.js), 6) AS js, round(avg(p.js), 6) AS null_mean, round(max(s.js) - avg(p.js), 6) AS excess, round(quantile_cont(p.js, 0.025), 6) AS low, round(quantile_cont(p.js, 0.975), 6) AS high, round((1 + count(*) FILTER (p.js >= s.js - 1e-12)) / 20, 6) AS p FROM stpjs s JOIN pmjs p ON p.layer = s.layer GROUP BY s.layer", "rt"))
def n02_label_permutation(spark, d):
    """19 permutations of labels within origin and stratum."""
    rows = routing(spark, d)
    seen = nulls.conditional_js(rows, ["layer"], ["i", "level"]).select("layer", F.col("js").alias("seen"))
    null = nulls.conditional_js(nulls.permuted_labels(rows, ["layer", "i", "level"], "row_id", 19, "perm"), ["layer", "rep"], ["i", "level"])
    g = null.join(seen, "layer").groupBy("layer").agg(F.max("seen").alias("js"), F.avg("js").alias("m"), F.percentile("js", F.lit(0.025)).alias("low"), F.percentile("js", F.lit(0.975)).alias("high"), F.count(F.when(F.col("js") >= F.col("seen") - 1e-12, 1)).alias("over"))  # a row a replicate
    return g.select("layer", r6("js"), r6("m", "null_mean"), r6(F.col("js") - F.col("m"), "excess"), r6("low"), r6("high"), r6((1 + F.col("over")) / 20, "p"))


@query(sql(f"{STEP}, c AS (SELECT layer, i, level, j, count(*) AS m, sum(label) AS a FROM stp GROUP BY ALL), t AS (SELECT *, sum(m) OVER w AS n, sum(a) OVER w AS n1 FROM c WINDOW w AS (PARTITION BY layer, i, level)), e AS (SELECT layer, i, level, j, n, n1, m, unnest(range(greatest(0, m - (n - n1))::BIGINT, least(m, n1)::BIGINT + 1)) AS x FROM t WHERE n1 >= 2 AND n - n1 >= 2), f AS (SELECT *, x / n1 AS p, (m - x) / (n - n1) AS q, exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n - m + 1) - lgamma(n1 - x + 1) - lgamma(n - m - n1 + x + 1) - lgamma(n + 1) + lgamma(n1 + 1) + lgamma(n - n1 + 1)) AS mass FROM e), g AS (SELECT layer, sum(n * mass * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS s FROM f GROUP BY layer), u AS (SELECT layer, sum(m) AS support FROM t WHERE n1 >= 2 AND n - n1 >= 2 GROUP BY layer) SELECT layer, round(s / support, 6) AS mean FROM g JOIN u USING (layer)", "rt"))
def n03_exact_mean(spark, d):
    return nulls.exact_mean(routing(spark, d), ["layer"], ["i", "level"]).select("layer", r6("mean"))


_SHUF = uniform_sql("columns", "layer || '|' || label || '|' || level || '|' || row_id")
SHUFFLED = f"own AS (SELECT row_id, layer, label, level, row_number() OVER (PARTITION BY layer, label, level ORDER BY row_id) AS k FROM rt), oth AS (SELECT layer, label, level, state, row_number() OVER (PARTITION BY layer, label, level ORDER BY {_SHUF}, row_id) AS k FROM rt), sh AS (SELECT row_id, own.layer, own.label, own.level, state FROM own JOIN oth ON own.layer = oth.layer AND own.label = oth.label AND own.level = oth.level AND own.k = oth.k)"


def shuffled(spark, d):
    rt = fx.rt(spark, d).select("row_id", "layer", "label", "level", "state")
    return nulls.shuffled(rt, ["layer", "label", "level"], "row_id", "state", "columns")


@query(sql(SHUFFLED + " SELECT row_id, layer, state FROM sh", "rt"))
def n04_column_shuffle(spark, d):
    """Each layer's states dealt anew within class and stratum, layers independently."""
    return shuffled(spark, d).select("row_id", "layer", "state")


@query(sql(f"{STEP}, {SHUFFLED}, ss AS (SELECT * FROM (SELECT row_id, label, level, layer, state AS i, lead(state) OVER (PARTITION BY row_id ORDER BY layer) AS j FROM sh) WHERE j IS NOT NULL), {_js_sql('stp', 'layer', 'i, level')}, {_js_sql('ss', 'layer', 'i, level')} SELECT round(avg(a.js), 6) AS observed, round(avg(b.js), 6) AS null_mean, round(avg(a.js) - avg(b.js), 6) AS excess FROM stpjs a LEFT JOIN ssjs b USING (layer)", "rt"))
def n05_occupancy_null(spark, d):
    """One draw that keeps each class's and stratum's occupancy of a layer and no pairing."""
    s = R.steps(shuffled(spark, d), "label", "level").select("row_id", "label", "level", F.col("layer_from").alias("layer"), F.col("state_from").alias("i"), F.col("state_to").alias("dest"))
    null = nulls.conditional_js(s, ["layer"], ["i", "level"]).select("layer", F.col("js").alias("null"))
    seen = nulls.conditional_js(routing(spark, d), ["layer"], ["i", "level"]).join(null, "layer", "left")
    return seen.agg(r6(F.avg("js"), "observed"), r6(F.avg("null"), "null_mean"), r6(F.avg("js") - F.avg("null"), "excess"))


_RSHUF = uniform_sql("occupancy", "layer || '|' || label || '|' || level || '|' || rep || '|' || row_id")
_EXACT = """ct AS (SELECT rep, layer, i, level, j, count(*) AS m, sum(label) AS a FROM st GROUP BY ALL), tt AS (SELECT *, sum(m) OVER w AS n, sum(a) OVER w AS n1 FROM ct WINDOW w AS (PARTITION BY rep, layer, i, level)),
 ee AS (SELECT rep, layer, n, n1, m, unnest(range(greatest(0, m - (n - n1))::BIGINT, least(m, n1)::BIGINT + 1)) AS x FROM tt WHERE n1 >= 2 AND n - n1 >= 2),
 ff AS (SELECT *, x / n1 AS p, (m - x) / (n - n1) AS q, exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n - m + 1) - lgamma(n1 - x + 1) - lgamma(n - m - n1 + x + 1) - lgamma(n + 1) + lgamma(n1 + 1) + lgamma(n - n1 + 1)) AS mass FROM ee),
 gg AS (SELECT rep, layer, sum(n * mass * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS s FROM ff GROUP BY ALL), uu AS (SELECT rep, layer, sum(m) AS support FROM tt WHERE n1 >= 2 AND n - n1 >= 2 GROUP BY ALL)"""
_OCC = f"""rr AS (SELECT * FROM rt, range(9) r(rep)), own AS (SELECT row_id, rep, layer, label, level, row_number() OVER (PARTITION BY layer, label, level, rep ORDER BY row_id) AS k FROM rr), oth AS (SELECT rep, layer, label, level, state, row_number() OVER (PARTITION BY layer, label, level, rep ORDER BY {_RSHUF}, row_id) AS k FROM rr),
 al AS (SELECT row_id, own.rep::INT AS rep, own.layer, own.label, own.level, state FROM own JOIN oth ON own.rep = oth.rep AND own.layer = oth.layer AND own.label = oth.label AND own.level = oth.level AND own.k = oth.k UNION ALL SELECT row_id, -1, layer, label, level, state FROM rt),
 st AS MATERIALIZED (SELECT * FROM (SELECT row_id, rep, label, level, layer, state AS i, lead(state) OVER (PARTITION BY rep, row_id ORDER BY layer) AS j FROM al) WHERE j IS NOT NULL),
 {_js_sql('st', 'layer, rep', 'i, level')}, {_EXACT},
 pp AS (SELECT rep, avg(js) AS js, avg(js - s / uu.support) AS c FROM stjs LEFT JOIN gg USING (rep, layer) LEFT JOIN uu USING (rep, layer) GROUP BY rep), ob AS (SELECT js AS js0, c AS c0 FROM pp WHERE rep = -1)"""
_PARTS = ", ".join(f"round(max({v}0), 6) AS {n}observed, round(avg({v}), 6) AS {n}null_mean, round(max({v}0) - avg({v}), 6) AS {n}excess, round(quantile_cont({v}, 0.025), 6) AS {n}low, round(quantile_cont({v}, 0.975), 6) AS {n}high, round((1 + count(*) FILTER ({v} >= {v}0 - 1e-12)) / 10, 6) AS {n}p" for v, n in (("js", ""), ("c", "corrected_")))


@query(sql(f"{_OCC} SELECT {_PARTS} FROM pp, ob WHERE rep >= 0", "rt"))
def n05_bias_corrected(spark, d):
    """Nine draws, and what is left after each map's exact mean over permuted labels."""
    t = nulls.occupancy_null(fx.rt(spark, d), ["layer", "label", "level"], 9, "occupancy")
    return t.select(*(r6(c) for c in t.columns))


_OCC = uniform_sql("occupancy", "rep || '|' || row_id")


@query(sql(f"h AS (SELECT row_id, state, count(*) / 8 AS h FROM routes GROUP BY ALL), y0 AS (SELECT row_id, -1 AS rep, label FROM emb UNION ALL SELECT row_id, rep, (row_number() OVER (PARTITION BY category, rep ORDER BY {_OCC}, row_id) <= ones)::INT FROM (SELECT *, sum(label) OVER (PARTITION BY category) AS ones FROM emb), range(19) t(rep)), n AS (SELECT rep, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM y0 GROUP BY rep), m AS (SELECT rep, state, coalesce(sum(h) FILTER (label = 1), 0) / max(n1) AS p, coalesce(sum(h) FILTER (label = 0), 0) / max(n0) AS q FROM h JOIN y0 USING (row_id) JOIN n USING (rep) GROUP BY ALL), s AS (SELECT rep, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM m GROUP BY rep), o AS (SELECT js AS seen FROM s WHERE rep = -1), v AS (SELECT sum(n)::DOUBLE / (SELECT count(*) FROM emb) AS movable FROM (SELECT category, count(*) AS n, count(DISTINCT label) AS k FROM emb GROUP BY category) WHERE k > 1) SELECT round(max(seen), 6) AS js, round((1 + count(*) FILTER (js >= seen - 1e-12)) / 20, 6) AS p, round(avg(js), 6) AS null_mean, round(coalesce(max(movable), 0), 6) AS movable FROM s, o, v WHERE rep >= 0", "routes", "emb"))
def n06_occupancy_permutation(spark, d):
    """Labels permuted within strata; js of the classes' mean occupancies."""
    e = fx.emb(spark, d).select("row_id", F.expr("concat(category, '')").alias("category"), "label")
    h = fx.routes(spark, d).groupBy("row_id", "state").agg((F.count("*") / fx.LAYERS).alias("h"))
    y = e.select("row_id", "label", F.lit(-1).alias("rep")).unionByName(nulls.permuted_labels(e, ["category"], "row_id", 19, "occupancy").select("row_id", "label", "rep"))
    n = y.groupBy("rep").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    m = h.join(y, "row_id").groupBy("rep", "state").agg(F.sum(F.col("h") * F.col("label")).alias("a"), F.sum(F.col("h") * (1 - F.col("label"))).alias("b")).join(n, "rep")
    s = m.groupBy("rep").agg(F.sum(nulls.js_bits(F.col("a") / F.col("n1"), F.col("b") / F.col("n0"))).alias("js"))
    seen = s.where("rep = -1").select(F.col("js").alias("seen"))
    strata = e.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"))
    v = strata.agg((F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("movable"))
    return s.where("rep >= 0").join(seen).join(v).agg(r6(F.max("seen"), "js"), r6((1 + F.count(F.when(F.col("js") >= F.col("seen") - 1e-12, 1))) / 20, "p"), r6(F.avg("js"), "null_mean"), r6(F.max("movable"), "movable"))


_SIL = uniform_sql("silhouette", "row_id")


@query(sql(f"q AS (SELECT row_id FROM emb ORDER BY {_SIL}, row_id LIMIT 400), s AS (SELECT layer, row_id, state, x FROM routes JOIN states USING (row_id, layer) JOIN q USING (row_id)), p AS (SELECT a.layer, a.row_id, a.state, b.state AS other, avg(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS dist FROM s a JOIN s b ON a.layer = b.layer AND a.row_id <> b.row_id GROUP BY ALL), t AS (SELECT layer, row_id, max(dist) FILTER (state = other) AS a, min(dist) FILTER (state <> other) AS b FROM p GROUP BY ALL) SELECT layer, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM t GROUP BY layer", "routes", "emb"))
def m02_silhouette(spark, d):
    """Euclidean silhouette over a hash sample of 400 rows; a row alone in its state counts 0."""
    pick = fx.emb(spark, d).orderBy(uniform("silhouette", F.col("row_id")), "row_id").limit(400).select("row_id")
    s = fx.states(spark, d).join(fx.routes(spark, d).select("row_id", "layer", "state"), ["row_id", "layer"]).join(pick, "row_id")
    o = s.select("layer", F.col("row_id").alias("r2"), F.col("state").alias("other"), F.col("x").alias("y"))
    p = s.join(o, "layer").where("row_id <> r2").groupBy("layer", "row_id", "state", "other").agg(F.avg(F.sqrt(A.sq_dist(F.col("x"), F.col("y")))).alias("d"))
    same = F.col("state") == F.col("other")
    t = p.groupBy("layer", "row_id").agg(F.max(F.when(same, F.col("d"))).alias("a"), F.min(F.when(~same, F.col("d"))).alias("b"))
    return t.groupBy("layer").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))), "silhouette"))


@query(sql("z AS (SELECT r.layer, r.row_id, r.state, s.x, mu, list_sum(list_transform(list_zip(s.x, mu), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM routes r JOIN states s USING (row_id, layer) JOIN means USING (layer, state)), g AS (SELECT layer, list(m ORDER BY i) AS all_mu FROM (SELECT layer, i, avg(x[i]) AS m FROM states, range(1, 9) t(i) GROUP BY ALL) GROUP BY layer), c AS (SELECT layer, state, count(*) AS n, sum(d2) AS w, avg(sqrt(d2)) AS sd, any_value(mu) AS mu FROM z GROUP BY ALL), b AS (SELECT c.*, list_sum(list_transform(list_zip(mu, all_mu), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d0 FROM c JOIN g USING (layer)), db AS (SELECT a.layer, a.state, max((a.sd + o.sd) / sqrt(list_sum(list_transform(list_zip(a.mu, o.mu), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS r FROM c a JOIN c o ON a.layer = o.layer AND a.state <> o.state GROUP BY ALL), dbi AS (SELECT layer, avg(r) AS db FROM db GROUP BY layer) SELECT layer, count(*) AS active_k, round((sum(n * d0) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz, round(max(db), 6) AS davies_bouldin, min(n) AS min_n, round(max(n) / sum(n), 6) AS max_share, count(*) FILTER (n = 1) AS singletons, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS occupancy_entropy FROM b JOIN dbi USING (layer) GROUP BY layer", "means"))
def m13_quality(spark, d):
    near = fx.routes(spark, d).select("row_id", "layer", "state")
    mu = fx.means(spark, d)
    z = fx.states(spark, d).join(near, ["row_id", "layer"]).join(mu, ["layer", "state"]).withColumn("d2", A.sq_dist(F.col("x"), F.col("mu")))
    c = z.groupBy("layer", "state").agg(F.count("*").alias("n"), F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("sd")).join(mu, ["layer", "state"])
    e = c.select("layer", "n", F.posexplode("mu").alias("i", "m")).groupBy("layer", "i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    g = e.groupBy("layer").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("all_mu"))  # a vector a layer
    o = c.select("layer", F.col("state").alias("o"), F.col("sd").alias("sd2"), F.col("mu").alias("mu2"))
    ratio = (F.col("sd") + F.col("sd2")) / F.sqrt(A.sq_dist(F.col("mu"), F.col("mu2")))
    db = c.join(o, "layer").where("state <> o").groupBy("layer", "state").agg(F.max(ratio).alias("r")).groupBy("layer").agg(F.avg("r").alias("db"))  # K x K a layer
    n, k = F.sum("n"), F.count("*")
    return c.join(g, "layer").join(db, "layer").groupBy("layer").agg(
        k.alias("active_k"), r6((F.sum(F.col("n") * A.sq_dist(F.col("mu"), F.col("all_mu"))) / (k - 1)) / (F.sum("w") / (n - k)), "calinski_harabasz"), r6(F.max("db"), "davies_bouldin"),
        F.min("n").alias("min_n"), r6(F.max("n") / n, "max_share"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), r6(F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n, "occupancy_entropy"),
    )


@query(sql("p AS (SELECT layer, state, label, dist, (rank() OVER w - 1 + 0.5 * count(*) OVER (PARTITION BY layer, state, dist)) / count(*) OVER (PARTITION BY layer, state) AS p FROM rt WINDOW w AS (PARTITION BY layer, state ORDER BY dist)), b AS (SELECT *, least(floor(p * 5), 4)::INT AS bin, avg(label) OVER (PARTITION BY layer, state) AS e FROM p), g AS (SELECT bin, count(*) AS n, avg(label) AS a, avg(sqrt(dist)) AS m, avg(label - e) AS x FROM b GROUP BY bin) SELECT bin, n, round(a, 6) AS accuracy, round((a + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(a * (1 - a) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS low, round((a + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(a * (1 - a) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS high, round(m, 6) AS mean_dist, round(x, 6) AS excess FROM g", "rt"))
def j23_distance_bins(spark, d):
    """Fifths of the distance to the centre within a state; what is expected is the state's mean."""
    rt = fx.rt(spark, d).select("layer", "state", "dist", "label")
    at = rt.groupBy("layer", "state", "dist").agg(F.count("*").alias("c"))
    run = running(at, ["layer", "state"], "dist", {"run": "c"})
    size = rt.groupBy("layer", "state").agg(F.count("*").alias("size"), F.avg("label").alias("e"))
    x = rt.join(run, ["layer", "state", "dist"]).join(size, ["layer", "state"])
    x = x.withColumn("bin", F.least(F.floor((F.col("run") - 0.5 * F.col("c")) / F.col("size") * 5), F.lit(4)).cast("int"))
    g = x.groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("a"), F.avg(F.sqrt("dist")).alias("m"), F.avg(F.col("label") - F.col("e")).alias("x"))
    low, high = wilson(F.col("a"), F.col("n"))
    return g.select("bin", "n", r6("a", "accuracy"), r6(low, "low"), r6(high, "high"), r6("m", "mean_dist"), r6("x", "excess"))


@query(sql("SELECT layer, i, round(avg(x[i]), 6) AS mean FROM states, range(1, 9) t(i) GROUP BY ALL", "states"))
def u01_layer_means(spark, d):
    """Mean vector of each layer over its rows."""
    e = fx.states(spark, d).select("layer", F.posexplode("x").alias("p", "v"))
    return e.groupBy("layer", (F.col("p") + 1).cast("long").alias("i")).agg(r6(F.avg("v"), "mean"))


@query(sql(f"g AS (SELECT DISTINCT sample FROM evt WHERE sample % 3 <> 0), k AS (SELECT sample FROM (SELECT sample, row_number() OVER (ORDER BY {uniform_sql('fit', 'sample')}, sample) AS i, count(*) OVER () AS n FROM g) WHERE i <= greatest(1, floor(0.4 * n))) SELECT sample, count(*) AS n FROM evt JOIN k USING (sample) GROUP BY sample", "evt"))
def p07_fit_fraction(spark, d):
    """Two fifths of the training groups, first in a hash order; all rows of a chosen group."""
    e = fx.evt(spark, d)
    g = e.where("sample % 3 <> 0").select("sample").distinct().select("sample", uniform("fit", F.col("sample")).alias("u"), F.lit(1).alias("one"))
    want = g.agg(F.greatest(F.lit(1), F.floor(0.4 * F.count("*"))).alias("want"))
    k = running(g, [], "u", {"i": "one"}).join(want).where("i <= want").select("sample")
    return e.join(k, "sample").groupBy("sample").agg(F.count("*").alias("n"))


@query(sql(JOINT + ", o AS (SELECT row_id, layer, state, r, logp, row_number() OVER (PARTITION BY row_id, layer ORDER BY r DESC, state) AS k FROM resp) SELECT o.row_id, o.layer, max(o.state) FILTER (k = 1) AS posterior_state, max(n.state) AS nearest_state, round(max(r) FILTER (k = 1), 6) AS confidence, round(max(r) FILTER (k = 1) - max(r) FILTER (k = 2), 6) AS margin, round(sqrt(max(n.dist) / 8), 6) AS rms, round(-max(logp), 6) AS surprise FROM o JOIN routes n ON n.row_id = o.row_id AND n.layer = o.layer GROUP BY o.row_id, o.layer", "routes"))
def d11_diagnostics(spark, d):
    """Posterior and nearest state, confidence, margin, distance and density of each row."""
    j = distances.gaussian_log_joint(fx.states(spark, d), model(spark, d))
    p = distances.responsibilities(j, ["row_id", "layer"])
    top = p.groupBy("row_id", "layer").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("resp")).alias("m"), "state"))), 1, 2).alias("o"), F.max("logp").alias("logp"))  # K a row
    near = fx.routes(spark, d).select("row_id", "layer", F.col("state").alias("nearest_state"), "dist")
    one, two = -F.col("o")[0]["m"], -F.get("o", F.lit(1))["m"]
    return top.join(near, ["row_id", "layer"]).select("row_id", "layer", F.col("o")[0]["state"].alias("posterior_state"), "nearest_state", r6(one, "confidence"), r6(one - two, "margin"), r6(F.sqrt(F.col("dist") / fx.WIDTH), "rms"), r6(-F.col("logp"), "surprise"))


@query(sql("z AS (SELECT r.row_id, r.layer, sum(x[i] * mu[i]) / sqrt(sum(x[i] * x[i]) * sum(mu[i] * mu[i])) AS c, sqrt(sum((x[i] - mu[i]) ** 2 / (0.01 + 0.001 * r.state)) / 8) AS m FROM routes r JOIN states s USING (row_id, layer) JOIN centers k ON k.layer = r.layer AND k.state = r.state, range(1, 9) t(i) GROUP BY ALL) SELECT row_id, layer, round(acos(least(greatest(c, -1), 1)), 5) AS angle, round(m, 6) AS mahalanobis FROM z", "routes"))
def d11_angles(spark, d):
    """Angle of each row to its centre, and Mahalanobis distance a dimension."""
    n = distances.nearest(fx.states(spark, d), fx.centers(spark, d))
    c = F.least(F.greatest(A.cosine(F.col("x"), F.col("mu")), F.lit(-1.0)), F.lit(1.0))
    return n.select("row_id", "layer", F.round(F.acos(c), 5).alias("angle"), r6(F.sqrt(F.col("dist") / (0.01 + 0.001 * F.col("state")) / fx.WIDTH), "mahalanobis"))


@query(sql("o AS (SELECT b.layer, a.state AS a, b.state AS b, count(*) AS n FROM routes a JOIN routes b ON a.row_id = b.row_id AND b.layer = a.layer + 1 GROUP BY ALL), z AS (SELECT *, n / sqrt(sum(n) OVER (PARTITION BY layer, a) * sum(n) OVER (PARTITION BY layer, b)) AS s FROM o) SELECT layer, a, b, n, round(s, 6) AS sim FROM z", "routes"))
def a04_shared_members(spark, d):
    """Overlap of the states of consecutive layers, over the geometric mean of their sizes."""
    e = R.transitions(fx.routes(spark, d).withColumn("label", F.lit(0)))
    size = lambda c: F.sum("n").over(Window.partitionBy("layer_to", c))
    return e.select(F.col("layer_to").alias("layer"), F.col("state_from").alias("a"), F.col("state_to").alias("b"), "n", r6(F.col("n") / F.sqrt(size("state_from") * size("state_to")), "sim"))


@query(sql("v AS (SELECT layer, i, avg(x[i]) AS m, avg(x[i] * x[i]) AS q FROM states, range(1, 9) t(i) GROUP BY ALL), n AS (SELECT layer, avg(sqrt(list_sum(list_transform(x, lambda v: v * v)))) AS norm, stddev_pop(sqrt(list_sum(list_transform(x, lambda v: v * v)))) AS sd FROM states GROUP BY layer), c AS (SELECT a.layer, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS cosine, sqrt(sum((b.m - a.m) * (b.m - a.m)) / sum(a.m * a.m)) AS drift FROM v a JOIN v b ON b.layer = a.layer + 1 AND a.i = b.i GROUP BY a.layer) SELECT n.layer, round(norm, 6) AS mean_norm, round(sd / norm, 6) AS norm_cv, round(cosine, 6) AS next_cosine, round(drift, 6) AS next_drift FROM n LEFT JOIN c USING (layer)", "states"))
def a10_center_drift(spark, d):
    """Norms of a layer's rows, and how its mean vector turns and moves to the next layer."""
    s = fx.states(spark, d)
    n = s.groupBy("layer").agg(F.avg(A.norm(F.col("x"))).alias("norm"), F.stddev_pop(A.norm(F.col("x"))).alias("sd"))
    v = s.select("layer", F.posexplode("x").alias("i", "v")).groupBy("layer", "i").agg(F.avg("v").alias("m"))
    b = v.select((F.col("layer") - 1).alias("layer"), "i", F.col("m").alias("k"))
    m, k = F.col("m"), F.col("k")
    c = v.join(b, ["layer", "i"]).groupBy("layer").agg((F.sum(m * k) / F.sqrt(F.sum(m * m) * F.sum(k * k))).alias("cosine"), F.sqrt(F.sum((k - m) * (k - m)) / F.sum(m * m)).alias("drift"))
    return n.join(c, "layer", "left").select("layer", r6("norm", "mean_norm"), r6(F.col("sd") / F.col("norm"), "norm_cv"), r6("cosine", "next_cosine"), r6("drift", "next_drift"))


@query(sql("l AS (SELECT row_id, (ln(n_tokens) - (SELECT avg(ln(n_tokens)) FROM emb)) / (SELECT stddev_pop(ln(n_tokens)) FROM emb) AS z FROM emb), e AS (SELECT layer, i, x[i] AS v, z FROM states JOIN l USING (row_id), range(1, 9) t(i)), c AS (SELECT layer, i, covar_pop(v, z) AS b, var_pop(v) AS s2 FROM e GROUP BY ALL) SELECT layer, round(sum(b * b) / sum(s2), 6) AS explained FROM c GROUP BY layer", "states", "emb"))
def g05_length_effect(spark, d):
    """Share of a layer's variance that standardised log length explains."""
    e = fx.emb(spark, d).select("row_id", F.log("n_tokens").alias("l"))
    m = e.agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"))  # one row
    z = e.join(m).select("row_id", ((F.col("l") - F.col("m")) / F.col("s")).alias("z"))
    v = fx.states(spark, d).join(z, "row_id").select("layer", "z", F.posexplode("x").alias("i", "v"))
    c = v.groupBy("layer", "i").agg(F.covar_pop("v", "z").alias("b"), F.var_pop("v").alias("s2"))
    return c.groupBy("layer").agg(r6(F.sum(F.col("b") * F.col("b")) / F.sum("s2"), "explained"))


@query(sql("e AS (SELECT layer, label, i, x[i] AS v, x[i] * x[i] / list_sum(list_transform(x, lambda v: v * v)) AS share FROM states JOIN emb USING (row_id), range(1, 9) t(i)) SELECT layer, label, i, count(*) AS n, round(avg(abs(v)), 6) AS mean_abs, round(stddev_samp(abs(v)) / sqrt(count(*)), 6) AS se_abs, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS se, round(avg(share), 6) AS energy, round(stddev_samp(share) / sqrt(count(*)), 6) AS se_energy FROM e GROUP BY ALL", "states", "emb"))
def g16_coordinates(spark, d):
    """Per layer, class and coordinate: mean and standard error of size, value and energy share."""
    s = fx.states(spark, d).join(fx.emb(spark, d).select("row_id", "label"), "row_id")
    e = s.withColumn("all", A.dot(F.col("x"), F.col("x"))).select("layer", "label", "all", F.posexplode("x").alias("p", "v"))
    se = lambda c: F.stddev_samp(c) / F.sqrt(F.count("*"))
    v, share = F.col("v"), F.col("v") * F.col("v") / F.col("all")
    return e.groupBy("layer", "label", (F.col("p") + 1).cast("long").alias("i")).agg(F.count("*").alias("n"), r6(F.avg(F.abs(v)), "mean_abs"), r6(se(F.abs(v)), "se_abs"), r6(F.avg(v), "mean"), r6(se(v), "se"), r6(F.avg(share), "energy"), r6(se(share), "se_energy"))


@query(sql("t AS (SELECT layer, i, avg(x[i]) FILTER (label = 1) - avg(x[i]) FILTER (label = 0) AS delta FROM states JOIN emb USING (row_id), range(1, 9) t(i) GROUP BY ALL), a AS (SELECT layer, i, delta FROM t WHERE abs(delta) >= 0.01 AND layer % 2 = 0), b AS (SELECT layer - 1 AS layer, i, delta FROM t WHERE abs(delta) >= 0.01 AND layer % 2 = 1) SELECT layer, count(a.delta) AS n_a, count(b.delta) AS n_b, count(*) FILTER (a.delta IS NOT NULL AND b.delta IS NOT NULL) AS shared, count(*) FILTER (a.delta * b.delta > 0) AS same_direction, round(count(*) FILTER (a.delta IS NOT NULL AND b.delta IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b USING (layer, i) GROUP BY layer", "states", "emb"))
def e23_coordinate_overlap(spark, d):
    """Coordinates with an effect in a layer against those of the next."""
    s = fx.states(spark, d).join(fx.emb(spark, d).select("row_id", "label"), "row_id").select("layer", "label", F.posexplode("x").alias("i", "v"))
    side = lambda y: F.avg(F.when(F.col("label") == y, F.col("v")))
    t = s.groupBy("layer", "i").agg((side(1) - side(0)).alias("delta")).where("abs(delta) >= 0.01")
    a = t.where("layer % 2 = 0").select("layer", "i", F.col("delta").alias("a"))
    b = t.where("layer % 2 = 1").select((F.col("layer") - 1).alias("layer"), "i", F.col("delta").alias("b"))
    both = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    return a.join(b, ["layer", "i"], "full").groupBy("layer").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), both.alias("shared"), F.count(F.when(F.col("a") * F.col("b") > 0, 1)).alias("same_direction"), r6(both / F.count("*"), "jaccard"))


POISSON_SQL = "(" + " + ".join(f"(u >= {c!r})::INT" for c in POISSON) + ")"
_GROUPS = uniform_sql("groups", "rep || '|' || (doc_id % 40)")


@query(sql(f"w AS (SELECT *, least(greatest(a / 4000, 0.01), 0.99) AS p, {POISSON_SQL} AS w FROM (SELECT a, label, rep, {_GROUPS} AS u FROM doc, range(100) t(rep))), s AS (SELECT rep, a, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM w GROUP BY ALL), o AS (SELECT *, sum(neg) OVER (PARTITION BY rep ORDER BY a) AS below FROM s), r AS (SELECT rep, sum(pos * (below - 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM o GROUP BY rep), l AS (SELECT rep, sum(w * (p - label) * (p - label)) / sum(w) AS brier, -sum(w * (label * ln(p) + (1 - label) * ln(1 - p))) / sum(w) AS log_loss FROM w GROUP BY rep), m AS (SELECT * FROM r JOIN l USING (rep)) SELECT round(quantile_cont(auc, 0.025), 6) AS auc_low, round(quantile_cont(auc, 0.975), 6) AS auc_high, round(quantile_cont(brier, 0.025), 6) AS brier_low, round(quantile_cont(brier, 0.975), 6) AS brier_high, round(quantile_cont(log_loss, 0.025), 6) AS loss_low, round(quantile_cont(log_loss, 0.975), 6) AS loss_high FROM m", "doc"))
def e07_cluster_bootstrap(spark, d):
    """100 replicates in which whole groups count as often as a Poisson draw says. A draw is
    made once a group, not a row; losses are summed by group before they are weighted."""
    x = fx.doc(spark, d).select("a", "label", (F.col("doc_id") % 40).alias("g"), F.least(F.greatest(F.col("a") / 4000, F.lit(0.01)), F.lit(0.99)).alias("p"))
    drawn = F.broadcast(x.select("g").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("w", poisson("groups", F.col("rep"), F.col("g"))))  # 40 groups
    p, y, w = F.col("p"), F.col("label"), F.col("w")
    sums = x.groupBy("g").agg(F.count("*").alias("n"), F.sum((p - y) * (p - y)).alias("b"), (-F.sum(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("l"))
    loss = sums.join(drawn, "g").groupBy("rep").agg(*((F.sum(w * F.col(c)) / F.nullif(F.sum(w * F.col("n")), F.lit(0))).alias(n) for c, n in (("b", "brier"), ("l", "log_loss"))))
    counts = x.groupBy("a", "label", "g").agg(F.count("*").alias("c")).join(drawn, "g")
    m = auroc(counts, "a", "label", ["rep"], weight=w * F.col("c")).select("rep", F.col("auroc").alias("auc")).join(loss, "rep")
    return m.agg(*(r6(F.percentile(c, F.lit(q)), n) for c, k in (("auc", "auc"), ("brier", "brier"), ("log_loss", "loss")) for q, n in ((0.025, f"{k}_low"), (0.975, f"{k}_high"))))  # a row a replicate


@query(sql("a AS (SELECT 'a' AS trial, layer, count(*) AS n, round(avg(label), 6) AS accuracy FROM rt GROUP BY layer), m AS (SELECT trial, layer, n, accuracy, 'kmeans' AS method FROM a WHERE layer % 2 = 0 UNION ALL SELECT trial, layer, n, accuracy, 'gmm' FROM a WHERE layer % 2 = 1) SELECT trial, layer, n, accuracy FROM m WHERE method = 'gmm' AND layer >= 3", "rt"))
def s15_catalog(spark, d):
    """Results with their metadata, selected by criteria."""
    a = fx.rt(spark, d).groupBy("layer").agg(F.count("*").alias("n"), r6(F.avg("label"), "accuracy")).withColumns({"trial": F.lit("a"), "method": F.when(F.col("layer") % 2 == 0, "kmeans").otherwise("gmm")})
    criteria = {"method": "gmm"}
    for k, v in criteria.items():
        a = a.where(F.col(k) == v)
    return a.where("layer >= 3").select("trial", "layer", "n", "accuracy")


@query(sql("n AS (SELECT s.row_id + 1000000 AS row_id, s.layer, list_transform(x, lambda v: v * 1.01) AS x FROM states s WHERE row_id % 3 = 0), r AS (SELECT n.row_id, n.layer, c.state, list_sum(list_transform(list_zip(n.x, c.mu), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM n JOIN means c ON n.layer = c.layer) SELECT row_id, layer, arg_min(state, (d, state)) AS state, round(sqrt(min(d)), 6) AS dist FROM r GROUP BY ALL", "means"))
def d10_apply_frozen(spark, d):
    """Stored centres applied to rows they were not learnt from."""
    new = fx.states(spark, d).where("row_id % 3 = 0").select((F.col("row_id") + 1000000).alias("row_id"), "layer", F.transform("x", lambda v: v * 1.01).alias("x"))
    return distances.nearest(new, fx.means(spark, d)).select("row_id", "layer", "state", r6(F.sqrt("dist"), "dist"))


@query(sql("r AS (SELECT layer, state, label FROM rt), g AS (SELECT state, layer, count(*) AS n FROM r GROUP BY ALL) SELECT state, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS purity, arg_max(layer, (n, -layer)) AS layer FROM g GROUP BY state", "rt"))
def c08_global_purity(spark, d):
    """Layers pooled under one set of states: how far a state belongs to one layer."""
    g = fx.rt(spark, d).groupBy("state", "layer").agg(F.count("*").alias("n"))
    return g.groupBy("state").agg(F.sum("n").alias("n"), r6(F.max("n") / F.sum("n"), "purity"), F.max_by("layer", F.struct("n", -F.col("layer"))).alias("layer"))
