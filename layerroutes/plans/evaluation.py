"""Queries of evaluation statistics, monitoring and model selection (E, W, M, P)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from layerroutes.functions.hashing import POISSON, fold, poisson, uniform
from layerroutes.functions.stats import auroc, place, quantiles, running
from layerroutes.operators import monitor
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql, uniform_sql
from layerroutes.plans.registry import query

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
POISSON_SQL = "(" + " + ".join(f"(u >= {c!r})::INT" for c in POISSON) + ")"
AUC = "sum(pos * (below - 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0)"


def auc_sql(src: str, by: str = "", w: str = "1") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"g AS (SELECT {keys}s, sum(CASE WHEN y = 1 THEN {w} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 0 THEN {w} ELSE 0 END)::DOUBLE AS neg FROM {src} GROUP BY {keys}s), o AS (SELECT *, sum(neg) OVER ({part}ORDER BY s) AS below FROM g)"


DOC = "d AS (SELECT *, a AS s, label AS y, " + uniform_sql("b", "doc_id") + " AS b FROM doc)"


def scored(spark, d):
    return fx.doc(spark, d).withColumn("b", uniform("b", F.col("doc_id")))


@query(sql(DOC + f", {auc_sql('d')} SELECT round({AUC}, 6) AS auroc FROM o", "doc"))
def e01_auroc(spark, d):
    return auroc(fx.doc(spark, d), "a", "label").select(r6("auroc"))


@query(sql(DOC + f", {auc_sql('d', w='level')} SELECT round({AUC}, 6) AS auroc FROM o", "doc"))
def e02_weighted_auroc(spark, d):
    return auroc(fx.doc(spark, d), "a", "label", weight=F.col("level")).select(r6("auroc"))


@query(sql(DOC + ", g AS (SELECT s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM d GROUP BY s), o AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(y) FROM d) AS p, (SELECT sum(1 - y) FROM d) AS n FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision, round(min(fp / n) FILTER (tp / p >= 0.95), 6) AS fpr_at_95 FROM o", "doc"))
def e03_average_precision(spark, d):
    g = fx.doc(spark, d).groupBy("a").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    o = running(g, [], "a", {"tp": "pos", "fp": "neg"}, descending=True)
    o = o.join(g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    tp, fp = F.col("tp"), F.col("fp")
    return o.agg(r6(F.sum(F.col("pos") / F.col("p") * tp / (tp + fp)), "average_precision"), r6(F.min(F.when(tp / F.col("p") >= 0.95, fp / F.col("n"))), "fpr_at_95"))


@query(sql(DOC + ", o AS (SELECT y, row_number() OVER (ORDER BY b DESC) AS i, count(*) OVER () AS n FROM d), c AS (SELECT k, max(n) AS n, ceil(max(n) * k / 10.0)::BIGINT AS kept, 1 - avg(y) AS risk FROM o JOIN range(1, 11) t(k) ON i <= ceil(n * k / 10.0) GROUP BY k) SELECT (k / 10.0)::DOUBLE AS coverage, kept, round(risk, 6) AS risk FROM c", "doc"))
def e03_risk_coverage(spark, d):
    """Share of errors among the rows of highest confidence, as more of them are kept."""
    n = F.col("n")
    ranked = place(scored(spark, d).select("label", "b"), [], -F.col("b"), "i")
    ranked = ranked.join(F.broadcast(ranked.agg(F.count("*").alias("n")))).withColumn("tenth", F.explode(F.sequence(F.lit(1), F.lit(10))))  # one row
    g = ranked.where(F.col("i") <= F.ceil(n * F.col("tenth") / 10.0)).groupBy("tenth").agg(F.count("*").alias("kept"), r6(1 - F.avg("label"), "risk"))
    return g.select((F.col("tenth") / 10.0).alias("coverage"), "kept", "risk")


@query(sql(DOC + ", c AS (SELECT y, b, (b >= 0.5)::INT AS h FROM d), k AS (SELECT sum(h * y)::DOUBLE tp, sum(h * (1 - y))::DOUBLE fp, sum((1 - h) * y)::DOUBLE fn, sum((1 - h) * (1 - y))::DOUBLE tn, avg((b - y) * (b - y)) AS brier, -avg(y * ln(greatest(b, 1e-15)) + (1 - y) * ln(greatest(1 - b, 1e-15))) AS log_loss, avg(y) AS prevalence FROM c) SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(prevalence, 6) AS prevalence, round(greatest(prevalence, 1 - prevalence), 6) AS majority FROM k", "doc"))
def e04_classification(spark, d):
    y, b = F.col("label"), F.col("b")
    h = (b >= 0.5).cast("int")
    k = scored(spark, d).agg(
        *(F.sum(x).cast("double").alias(n) for n, x in (("tp", h * y), ("fp", h * (1 - y)), ("fn", (1 - h) * y), ("tn", (1 - h) * (1 - y)))),
        F.avg((b - y) * (b - y)).alias("brier"), (-F.avg(y * F.log(F.greatest(b, F.lit(1e-15))) + (1 - y) * F.log(F.greatest(1 - b, F.lit(1e-15))))).alias("log_loss"), F.avg(y).alias("p"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return k.select(r6((tp + tn) / (tp + fp + fn + tn), "accuracy"), r6((tp / (tp + fn) + tn / (tn + fp)) / 2, "balanced"), r6(2 * tp / (2 * tp + fp + fn), "f1"), r6((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), "mcc"), r6("brier"), r6("log_loss"), r6("p", "prevalence"), r6(F.greatest("p", 1 - F.col("p")), "majority"))


@query(sql(DOC + f", {auc_sql('d', 'level')}, p AS (SELECT level, sum(pos * (below - 0.5 * neg)) AS wins, sum(pos) * sum(neg) AS pairs FROM o GROUP BY level) SELECT round(sum(wins) / sum(pairs), 6) AS auroc, sum(pairs)::BIGINT AS pairs, count(*) FILTER (pairs > 0) AS strata FROM p", "doc"))
def e05_stratum_auroc(spark, d):
    p = auroc(fx.doc(spark, d), "a", "label", ["level"])
    return p.agg(r6(F.sum("wins") / F.sum("pairs"), "auroc"), F.sum("pairs").cast("long").alias("pairs"), F.count(F.when(F.col("pairs") > 0, 1)).alias("strata"))


@query(sql(DOC + f", {auc_sql('d', 'level')} SELECT round(avg(a), 6) AS macro_auroc, count(a) AS groups FROM (SELECT level, {AUC} AS a FROM o GROUP BY level)", "doc"))
def e06_macro_auroc(spark, d):
    return auroc(fx.doc(spark, d), "a", "label", ["level"]).agg(r6(F.avg("auroc"), "macro_auroc"), F.count("auroc").alias("groups"))


@query(sql(f"b AS (SELECT *, {uniform_sql('boot', chr(39) + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || doc_id')} AS u FROM doc, range(200) t(rep)), d AS (SELECT a AS s, label AS y, rep, {POISSON_SQL} AS w FROM b), {auc_sql('d', 'rep', 'w')}, a AS (SELECT rep, {AUC} AS a FROM o GROUP BY rep) SELECT round(avg(a), 6) AS mean, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM a", "doc"))
def e08_bootstrap_auroc(spark, d):
    """200 replicates in which each row counts as often as a Poisson draw says: the bootstrap
    whose draws need no common total, so that rows never meet. Rows drawn 0 times stay in with
    weight 0: a filter on the draw would hash each of them again for every step of it."""
    x = fx.doc(spark, d).select("doc_id", "a", "label", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("rep"))
    a = auroc(x.withColumn("w", poisson("boot", F.col("rep"), F.col("doc_id"))), "a", "label", ["rep"], weight=F.col("w"))
    return a.agg(r6(F.avg("auroc"), "mean"), r6(F.percentile("auroc", F.lit(0.025)), "low"), r6(F.percentile("auroc", F.lit(0.975)), "high"))


@query(sql("x AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY user_id) SELECT count(*) AS n, round(avg(a - b), 6) AS diff, round(avg(a - b) - 1.96 * stddev_samp(a - b) / sqrt(count(*)), 6) AS low, round(avg(a - b) + 1.96 * stddev_samp(a - b) / sqrt(count(*)), 6) AS high, round(sum(a) / sum(b), 6) AS ratio FROM x WHERE a IS NOT NULL AND b IS NOT NULL", "evt"))
def e09_paired_difference(spark, d):
    even = F.col("event_id") % 2 == 0
    x = fx.table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(even, F.col("value"))).alias("a"), F.avg(F.when(~even, F.col("value"))).alias("b")).dropna()
    diff = F.col("a") - F.col("b")
    half = 1.96 * F.stddev_samp(diff) / F.sqrt(F.count("*"))
    return x.agg(F.count("*").alias("n"), r6(F.avg(diff), "diff"), r6(F.avg(diff) - half, "low"), r6(F.avg(diff) + half, "high"), r6(F.sum("a") / F.sum("b"), "ratio"))


@query(sql(DOC + ", c AS (SELECT (a > 1500)::INT = y AS ra, (b >= 0.5)::INT = y AS rb FROM d) SELECT count(*) AS n, count(*) FILTER (NOT ra AND rb) AS repairs, count(*) FILTER (ra AND NOT rb) AS damages, round(avg(rb::INT) - avg(ra::INT), 6) AS delta FROM c", "doc"))
def e10_paired_accuracy(spark, d):
    c = scored(spark, d).select(((F.col("a") > 1500).cast("int") == F.col("label")).alias("ra"), ((F.col("b") >= 0.5).cast("int") == F.col("label")).alias("rb"))
    return c.agg(F.count("*").alias("n"), F.count(F.when(~F.col("ra") & F.col("rb"), 1)).alias("repairs"), F.count(F.when(F.col("ra") & ~F.col("rb"), 1)).alias("damages"), r6(F.avg(F.col("rb").cast("int")) - F.avg(F.col("ra").cast("int")), "delta"))


@query(sql(DOC + ", c AS (SELECT doc_id, (a > 1500)::INT = y AS ra, (b >= 0.5)::INT = y AS rb FROM d) SELECT doc_id, CASE WHEN rb THEN 'repair' ELSE 'damage' END AS flip FROM c WHERE ra <> rb", "doc"))
def e10_flips(spark, d):
    """The rows that the second method repairs or damages."""
    c = scored(spark, d).select("doc_id", ((F.col("a") > 1500).cast("int") == F.col("label")).alias("ra"), ((F.col("b") >= 0.5).cast("int") == F.col("label")).alias("rb"))
    return c.where("ra <> rb").select("doc_id", F.when(F.col("rb"), "repair").otherwise("damage").alias("flip"))


EX = "e AS (SELECT layer, i, x[i] AS v, label FROM states JOIN emb USING (row_id), range(1, 9) t(i)), g AS (SELECT layer, i, avg(v) FILTER (label = 1) AS m1, avg(v) FILTER (label = 0) AS m0, var_samp(v) FILTER (label = 1) AS v1, var_samp(v) FILTER (label = 0) AS v0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, corr(v, label) AS r FROM e GROUP BY ALL)"


def _coordinates(spark, d):
    e = fx.states(spark, d).join(fx.emb(spark, d).select("row_id", "label"), "row_id").select("layer", F.posexplode("x").alias("i", "v"), "label")
    side = lambda f, y: f(F.when(F.col("label") == y, F.col("v")))
    return e.groupBy("layer", (F.col("i") + 1).cast("long").alias("i")).agg(side(F.avg, 1).alias("m1"), side(F.avg, 0).alias("m0"), side(F.var_samp, 1).alias("v1"), side(F.var_samp, 0).alias("v0"), side(F.count, 1).alias("n1"), side(F.count, 0).alias("n0"), F.corr("v", "label").alias("r"))


@query(sql(EX + " SELECT layer, i, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM g", "states", "emb"))
def e11_welch(spark, d):
    c = F.col
    g = _coordinates(spark, d)
    return g.select("layer", "i", r6((c("m1") - c("m0")) / F.sqrt(c("v1") / c("n1") + c("v0") / c("n0")), "t"), r6((c("m1") - c("m0")) / F.sqrt(((c("n1") - 1) * c("v1") + (c("n0") - 1) * c("v0")) / (c("n1") + c("n0") - 2)), "d"))


@query(sql(EX + ", p AS (SELECT layer, i, exp(-abs((m1 - m0) / sqrt(v1 / n1 + v0 / n0))) AS p FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY p, i) AS j, count(*) OVER (PARTITION BY layer) AS m FROM p) SELECT layer, i, round(min(least(1, p * m / j)) OVER (PARTITION BY layer ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q FROM k", "states", "emb"))
def e12_benjamini_hochberg(spark, d):
    c = F.col
    p = _coordinates(spark, d).withColumn("p", F.exp(-F.abs((c("m1") - c("m0")) / F.sqrt(c("v1") / c("n1") + c("v0") / c("n0")))))
    w = Window.partitionBy("layer")
    k = p.withColumns({"j": F.row_number().over(w.orderBy("p", "i")), "m": F.count("*").over(w)})
    return k.select("layer", "i", r6(F.min(F.least(F.lit(1.0), c("p") * c("m") / c("j"))).over(w.orderBy("j").rowsBetween(0, Window.unboundedFollowing)), "q"))


def with_adjustment(coordinates, adjustment: int):
    """Correlations (r, n1, n0) with df, at least 1, and t after ``adjustment`` degrees of freedom."""
    r, df = F.col("r"), F.greatest(F.col("n1") + F.col("n0") - 2 - adjustment, F.lit(1))
    return coordinates.withColumns({"df": df, "t": r * F.sqrt(df / F.greatest(1 - r * r, F.lit(1e-15)))})


@query(sql(EX + " SELECT layer, i, round(r, 6) AS r, round(r * sqrt((n1 + n0 - 2) / (1 - r * r)), 6) AS t FROM g", "states", "emb"))
def e13_pearson(spark, d):
    r = F.col("r")
    return _coordinates(spark, d).select("layer", "i", r6("r"), r6(r * F.sqrt((F.col("n1") + F.col("n0") - 2) / (1 - r * r)), "t"))


@query(sql(EX + " SELECT layer, i, round(r, 6) AS r, n1 + n0 - 5 AS df, round(r * sqrt((n1 + n0 - 5) / greatest(1 - r * r, 1e-15)), 6) AS t FROM g", "states", "emb"))
def e13_adjusted(spark, d):
    """The same with three degrees of freedom taken off for controls."""
    g = with_adjustment(_coordinates(spark, d), 3)
    return g.select("layer", "i", r6("r"), "df", r6("t"))


@query(sql(DOC + ", r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM d) SELECT round(corr(ra, rb), 6) AS rho FROM r", "doc"))
def e15_spearman(spark, d):
    s = scored(spark, d)
    for c in ("a", "b"):
        at = running(s.groupBy(c).agg(F.count("*").alias("n")), [], c, {"upto": "n"})
        s = s.join(at.select(c, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}")), c)
    return s.agg(r6(F.corr("ra", "rb"), "rho"))


@query("WITH x AS (SELECT l_orderkey AS k, sum(l_extendedprice)::DOUBLE - 150000 AS v FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS i, count(*) OVER () AS n FROM x) SELECT round(quantile_cont(v, 0.5), 4) AS median, round(avg((v > 0)::INT), 6) AS positive, round(sum(v) FILTER (i <= ceil(n * 0.1)) / sum(v), 6) AS top_share, round(avg(v) FILTER (i > ceil(n * 0.1)), 4) AS rest_mean FROM r")
def e17_heavy_tail(spark, d):
    x = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.sum("l_extendedprice").cast("double") - 150000).alias("v"))
    n = x.agg(F.count("*").alias("n"))
    by_value = x.groupBy("v").agg(F.count("*").alias("c"))
    cut = running(by_value, [], "v", {"upto": "c"}, descending=True).join(n)
    top = F.greatest(F.lit(0), F.least(F.col("c"), F.ceil(F.col("n") * 0.1) - (F.col("upto") - F.col("c"))))  # of ties, as many as still fit
    cut = cut.withColumn("top", top)
    v, c = F.col("v"), F.col("c")
    out = cut.agg(F.sum(F.when(v > 0, c).otherwise(0)).alias("pos"), F.sum(c).alias("n"), F.sum(v * F.col("top")).alias("ts"), F.sum(v * c).alias("s"), F.sum(v * (c - F.col("top"))).alias("rs"), F.sum(c - F.col("top")).alias("rn"))
    return out.join(quantiles(x, [], "v", [0.5]).select(F.round("q0", 4).alias("median"))).select("median", r6(F.col("pos") / F.col("n"), "positive"), r6(F.col("ts") / F.col("s"), "top_share"), F.round(F.col("rs") / F.col("rn"), 4).alias("rest_mean"))


@query(sql("w AS (SELECT sample, avg(score) FILTER (token_end = 1) AS first, avg(score) FILTER (token_end <= 16) AS w16, avg(score) FILTER (token_end BETWEEN 2 AND 16) AS w2_16, avg(score) FILTER (token_end > 16) AS after, avg(score) AS whole FROM evt GROUP BY sample) SELECT sample, round(first, 6) AS first, round(w16, 6) AS w16, round(w2_16, 6) AS w2_16, round(after, 6) AS after, round(whole, 6) AS whole, round(whole - first, 6) AS delta FROM w", "evt"))
def e18_loss_windows(spark, d):
    t, s = F.col("token_end"), F.col("score")
    part = {"first": t == 1, "w16": t <= 16, "w2_16": t.between(2, 16), "after": t > 16, "whole": F.lit(True)}
    w = fx.evt(spark, d).groupBy("sample").agg(*(F.avg(F.when(c, s)).alias(n) for n, c in part.items()))
    return w.select("sample", *(r6(n) for n in part), r6(F.col("whole") - F.col("first"), "delta"))


@query(sql("z AS (SELECT sample, avg(score) AS base, avg(score) FILTER (token_end > 1) + 20 AS zero, avg(least(score, 300)) AS x FROM evt GROUP BY sample) SELECT count(*) AS n, round(sum(zero - x) / sum(zero - base), 6) AS recovered, round(avg(x - base), 6) AS delta FROM z", "evt"))
def e18_recovered(spark, d):
    """How much of the loss between a baseline and no input at all a change wins back: sums over
    samples of zero less changed, by zero less baseline."""
    s = F.col("score")
    z = fx.evt(spark, d).groupBy("sample").agg(F.avg(s).alias("base"), (F.avg(F.when(F.col("token_end") > 1, s)) + 20).alias("zero"), F.avg(F.least(s, F.lit(300.0))).alias("x"))
    return z.agg(F.count("*").alias("n"), r6(F.sum(F.col("zero") - F.col("x")) / F.sum(F.col("zero") - F.col("base")), "recovered"), r6(F.avg(F.col("x") - F.col("base")), "delta"))


@query(sql("c AS (SELECT category, sample, max(label) AS y, count(*) AS n, count(DISTINCT event_type) AS kinds FROM evt GROUP BY ALL) SELECT category, count(*) AS trajectories, CASE WHEN min(y) = 1 THEN 'all right' WHEN max(y) = 0 THEN 'all wrong' ELSE 'mixed' END AS kind, sum(n)::BIGINT AS boundaries, count(*) FILTER (n > 60) AS long FROM c GROUP BY category", "evt"))
def e22_coverage(spark, d):
    c = fx.evt(spark, d).groupBy("category", "sample").agg(F.max("label").alias("y"), F.count("*").alias("n"))
    kind = F.when(F.min("y") == 1, "all right").when(F.max("y") == 0, "all wrong").otherwise("mixed")
    return c.groupBy("category").agg(F.count("*").alias("trajectories"), kind.alias("kind"), F.sum("n").alias("boundaries"), F.count(F.when(F.col("n") > 60, 1)).alias("long"))


@query(sql("p AS (SELECT category, sample, string_agg(event_type, ',' ORDER BY token_end) FILTER (token_end <= 3) AS prefix, max(n_tokens) >= 60 AS cut FROM evt GROUP BY ALL) SELECT category, count(*) AS trajectories, count(DISTINCT prefix) AS prefixes, count(*) FILTER (cut) AS truncated FROM p GROUP BY category", "evt"))
def e22_prefixes(spark, d):
    """Different beginnings of three units per group, and trajectories of the full length."""
    first = F.sort_array(F.collect_list(F.when(F.col("token_end") <= 3, F.struct("token_end", "event_type"))))  # three a sample
    p = fx.evt(spark, d).groupBy("category", "sample").agg(first.alias("prefix"), (F.max("n_tokens") >= 60).alias("cut"))
    return p.groupBy("category").agg(F.count("*").alias("trajectories"), F.countDistinct("prefix").alias("prefixes"), F.count(F.when(F.col("cut"), 1)).alias("truncated"))


def far_sql(final: bool) -> str:
    m = "max(score)" if final else "max(score) FILTER (NOT is_final)"
    return f"t AS (SELECT sample, {m} AS m FROM evt WHERE label = 1 GROUP BY sample), f AS (SELECT coalesce(m, (SELECT min(score) - 1e-9 FROM evt)) AS m, row_number() OVER (ORDER BY coalesce(m, (SELECT min(score) - 1e-9 FROM evt))) AS i, count(*) OVER () AS n FROM t), th AS (SELECT m AS threshold FROM f WHERE i = greatest(0, n - floor(0.1 * n) - 1) + 1)"


@query(sql(far_sql(True) + " SELECT round(threshold, 6) AS threshold FROM th", "evt"))
def w01_far_threshold(spark, d):
    return monitor.far_threshold(fx.evt(spark, d), 0.1).select(r6("threshold"))


CASES = far_sql(False) + ", k AS (SELECT sample, max(label) AS label, max((score > threshold AND NOT is_final)::INT) AS alarm, max((NOT is_final)::INT) AS covered, min(token_end) FILTER (score > threshold AND NOT is_final) AS fe, max(n_tokens) AS n, arg_max(score, token_end) FILTER (token_end <= 0.5 * n_tokens) AS half_score, max(score) FILTER (is_final) AS final_score FROM evt, th GROUP BY sample)"


@query(sql(CASES + " SELECT sample, label, alarm, fe IS NOT NULL AS early, round(coalesce(1 - fe / n, 0), 6) AS saved, round(half_score, 6) AS half_score, round(final_score, 6) AS final_score FROM k", "evt"))
def w02_cases(spark, d):
    e = fx.evt(spark, d)
    c = monitor.cases(e.join(monitor.far_threshold(e, 0.1, final=False)), F.col("threshold"), final=False)
    return c.select("sample", "label", "alarm", "early", r6("saved"), r6("half_score"), r6("final_score"))


@query(sql(CASES + " SELECT count(*) AS n, round(avg(alarm) FILTER (label = 1), 6) AS far, round(avg(alarm) FILTER (label = 0), 6) AS detected, round(avg((fe IS NOT NULL)::INT) FILTER (label = 0), 6) AS early, round(avg(coalesce(1 - fe / n, 0)) FILTER (label = 0), 6) AS saved, round(avg(coalesce(1 - fe / n, 0)), 6) AS saved_all, round(avg(covered), 6) AS coverage, round(avg((half_score IS NOT NULL)::INT), 6) AS half_coverage FROM k", "evt"))
def w04_metrics(spark, d):
    e = fx.evt(spark, d)
    m = monitor.metrics(monitor.cases(e.join(monitor.far_threshold(e, 0.1, final=False)), F.col("threshold"), final=False))
    return m.select("n", *(r6(c) for c in ("far", "detected", "early", "saved", "saved_all", "coverage", "half_coverage")))


_CASE_U = uniform_sql("cases", "rep || '|' || sample")


@query(sql(CASES + f", b AS (SELECT *, {_CASE_U} AS u FROM k, range(100) t(rep)), w AS (SELECT *, {POISSON_SQL} AS w FROM b), m AS (SELECT rep, sum(w * alarm) FILTER (label = 1) / sum(w) FILTER (label = 1) AS far, sum(w * alarm) FILTER (label = 0) / sum(w) FILTER (label = 0) AS det, sum(w * coalesce(1 - fe / n, 0)) FILTER (label = 0) / sum(w) FILTER (label = 0) AS saved FROM w GROUP BY rep) SELECT round(quantile_cont(far, 0.025), 6) AS far_low, round(quantile_cont(far, 0.975), 6) AS far_high, round(quantile_cont(det, 0.025), 6) AS detected_low, round(quantile_cont(det, 0.975), 6) AS detected_high, round(quantile_cont(saved, 0.025), 6) AS saved_low, round(quantile_cont(saved, 0.975), 6) AS saved_high FROM m", "evt"))
def w04_group_bootstrap(spark, d):
    """Percentiles of the pooled ratios over 100 replicates, in which a whole response counts as
    often as a Poisson draw says. Weights of all replicates are summed beside each other."""
    e = fx.evt(spark, d)
    c = monitor.cases(e.join(monitor.far_threshold(e, 0.1, final=False)), F.col("threshold"), final=False)
    x = c.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("w", poisson("cases", F.col("rep"), F.col("sample")))
    ratio = lambda v, y: F.sum(F.when(F.col("label") == y, F.col("w") * v)) / F.sum(F.when(F.col("label") == y, F.col("w")))
    m = x.groupBy("rep").agg(ratio(F.col("alarm"), 1).alias("far"), ratio(F.col("alarm"), 0).alias("detected"), ratio(F.col("saved"), 0).alias("saved"))
    return m.agg(*(r6(F.percentile(v, F.lit(q)), f"{v}_{n}") for v in ("far", "detected", "saved") for n, q in (("low", 0.025), ("high", 0.975))))  # a row a replicate


@query(sql(CASES + " SELECT fe AS token_end, count(*) AS responses, count(*) FILTER (label = 1) AS false_alarms FROM k WHERE fe IS NOT NULL GROUP BY fe", "evt"))
def w04_first_boundaries(spark, d):
    """At which boundary responses raise their first alarm."""
    e = fx.evt(spark, d)
    c = monitor.cases(e.join(monitor.far_threshold(e, 0.1, final=False)), F.col("threshold"), final=False).where("first_early is not null")
    return c.groupBy(F.col("first_early").alias("token_end")).agg(F.count("*").alias("responses"), F.count(F.when(F.col("label") == 1, 1)).alias("false_alarms"))


@query(sql("b AS (SELECT sample, n_tokens, unnest([10, 20, 40]) AS pos FROM evt WHERE token_end = 1), s AS (SELECT b.sample, pos, n_tokens, score FROM b LEFT JOIN evt e ON e.sample = b.sample AND e.token_end = pos), f AS (SELECT sample, max(n_tokens) AS n, min(pos) FILTER (score > 400) AS first, count(score) AS present FROM s GROUP BY sample) SELECT sample, first, present, greatest(coalesce(n - first, 0), 0)::BIGINT AS saved FROM f".replace("n_tokens, unnest", "max(n_tokens) OVER (PARTITION BY sample) AS n_tokens, unnest").replace("s AS (SELECT b.sample, pos, n_tokens", "s AS (SELECT b.sample, pos, b.n_tokens"), "evt"))
def w03_fixed_boundaries(spark, d):
    e = fx.evt(spark, d).where(F.col("token_end").isin(1, 10, 20, 40))
    at = {b: F.max(F.when(F.col("token_end") == b, F.col("score"))).alias(f"s{b}") for b in (10, 20, 40)}
    g = e.groupBy("sample").agg(F.max("n_tokens").alias("n"), *at.values())
    first = F.coalesce(*(F.when(F.col(f"s{b}") > 400, F.lit(b)) for b in at))
    return g.select("sample", first.alias("first"), sum((F.col(f"s{b}").isNotNull().cast("long") for b in at), F.lit(0).cast("long")).alias("present"), F.greatest(F.coalesce(F.col("n") - first, F.lit(0)), F.lit(0)).cast("long").alias("saved"))


@query(sql("u AS (SELECT sample, token_end, avg(entropy) OVER w AS e, avg(logprob) OVER w AS l FROM evt WINDOW w AS (PARTITION BY sample ORDER BY token_end)) SELECT sample, token_end, round(e + 1e-12, 9) AS prefix_entropy, round(l + 1e-12, 9) AS prefix_logprob FROM u", "evt"))
def u06_prefix_uncertainty(spark, d):
    w = Window.partitionBy("sample").orderBy("token_end").rowsBetween(Window.unboundedPreceding, 0)
    return fx.evt(spark, d).select("sample", "token_end", F.round(F.avg("entropy").over(w) + 1e-12, 9).alias("prefix_entropy"), F.round(F.avg("logprob").over(w) + 1e-12, 9).alias("prefix_logprob"))


SC = ", ".join(["ok AS (SELECT * FROM scan WHERE stability >= 0.40)", "use_ AS (SELECT * FROM ok UNION ALL SELECT * FROM scan WHERE layer NOT IN (SELECT layer FROM ok))"])


def parsimonious(s, pct):
    """Stable rows (all where a layer has none); smallest k within best + |best| * pct."""
    ok = F.col("stability") >= 0.40
    w = Window.partitionBy("layer")
    use = s.withColumn("any", F.max(ok.cast("int")).over(w)).where(ok | (F.col("any") == 0)).withColumn("best", F.min("icl").over(w))
    return use.where(F.col("icl") <= F.col("best") + F.abs("best") * pct)


def parsimonious_k(s, pct):
    """(layer, k) of ``parsimonious``, and where no row of a layer has a criterion, the K of the
    greatest silhouette (the smallest of equals)."""
    least = parsimonious(s, pct).groupBy("layer").agg(F.min("k").alias("k"))
    bare = s.groupBy("layer").agg(F.max("icl").alias("_icl"), F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("_k")).where("_icl is null")
    return least.unionByName(bare.select("layer", F.col("_k").alias("k")))


@query(sql(SC + " SELECT layer, min(k) AS k FROM (SELECT *, min(icl) OVER (PARTITION BY layer) AS best FROM use_) WHERE icl <= best + abs(best) * 0.01 GROUP BY layer", "scan"))
def m05_parsimonious(spark, d):
    return parsimonious(fx.scan(spark, d), 0.01).groupBy("layer").agg(F.min("k").alias("k"))


@query(sql("sc AS (SELECT * REPLACE (CASE WHEN layer % 2 = 0 THEN NULL ELSE icl END AS icl) FROM scan), " + SC.replace("FROM scan", "FROM sc") + " SELECT layer, min(k) AS k FROM (SELECT *, min(icl) OVER (PARTITION BY layer) AS best FROM use_) WHERE icl <= best + abs(best) * 0.01 GROUP BY layer UNION ALL SELECT layer, arg_max(k, (silhouette, -k)) FROM sc GROUP BY layer HAVING max(icl) IS NULL", "scan"))
def m05_without_criterion(spark, d):
    """The same where half of the layers have no criterion at all."""
    s = fx.scan(spark, d)
    return parsimonious_k(s.withColumn("icl", F.when(F.col("layer") % 2 == 1, F.col("icl"))), 0.01)


@query(sql(SC + " SELECT layer, arg_max(k, (silhouette, -k)) AS k FROM use_ GROUP BY layer", "scan"))
def m06_silhouette(spark, d):
    ok = F.col("stability") >= 0.40
    use = fx.scan(spark, d).withColumn("any", F.max(ok.cast("int")).over(Window.partitionBy("layer"))).where(ok | (F.col("any") == 0))
    return use.groupBy("layer").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))


PCTS = [0.0, 0.005, 0.01, 0.02, 0.05]
CHOSEN = SC + ", c AS (SELECT pct, layer, min(k) AS k FROM (SELECT *, min(icl) OVER (PARTITION BY layer) AS best FROM use_), (SELECT unnest([0.0, 0.005, 0.01, 0.02, 0.05])::DOUBLE AS pct) WHERE icl <= best + abs(best) * pct GROUP BY ALL)"


def _chosen(spark, d):
    s = fx.scan(spark, d).withColumn("pct", F.explode(F.array(*map(F.lit, PCTS))))
    ok = F.col("stability") >= 0.40
    w = Window.partitionBy("layer", "pct")
    use = s.withColumn("any", F.max(ok.cast("int")).over(w)).where(ok | (F.col("any") == 0)).withColumn("best", F.min("icl").over(w))
    return use.where(F.col("icl") <= F.col("best") + F.abs("best") * F.col("pct")).groupBy("pct", "layer").agg(F.min("k").alias("k"))


@query(sql(CHOSEN + ", a AS (SELECT pct, avg(k) AS m FROM c GROUP BY pct) SELECT pct, round(m, 6) AS mean_k FROM a ORDER BY abs(m - 4), pct LIMIT 1", "scan"))
def m07_target_k(spark, d):
    a = _chosen(spark, d).groupBy("pct").agg(F.avg("k").alias("m"))
    return a.agg(F.min(F.struct(F.abs(F.col("m") - 4), "pct", "m")).alias("b")).select("b.pct", r6("b.m", "mean_k"))


@query(sql("SELECT layer, min(k) AS k FROM (SELECT *, min(icl) OVER (PARTITION BY layer) AS best FROM scan WHERE converged) WHERE icl <= best + 0.02 * greatest(abs(best), 1) GROUP BY layer", "scan"))
def m08_candidate(spark, d):
    s = fx.scan(spark, d).where("converged").withColumn("best", F.min("icl").over(Window.partitionBy("layer")))
    return s.where(F.col("icl") <= F.col("best") + 0.02 * F.greatest(F.abs("best"), F.lit(1.0))).groupBy("layer").agg(F.min("k").alias("k"))


@query(sql(CHOSEN + " SELECT pct, round(avg(k), 6) AS mean_k, round(stddev_pop(k), 6) AS std_k, min(k) AS min_k, max(k) AS max_k FROM c GROUP BY pct", "scan"))
def m09_tolerance_sweep(spark, d):
    return _chosen(spark, d).groupBy("pct").agg(r6(F.avg("k"), "mean_k"), r6(F.stddev_pop("k"), "std_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


@query(sql("s AS (SELECT *, min(icl) OVER (PARTITION BY layer) AS best FROM scan) SELECT layer, k, round((icl - best) / abs(best), 6) AS relative, stability >= 0.40 AS eligible, icl <= best * 1.01 AS near, row_number() OVER (PARTITION BY layer ORDER BY icl, k) = 1 AS selected FROM s", "scan"))
def m10_surface(spark, d):
    w = Window.partitionBy("layer")
    s = fx.scan(spark, d).withColumn("best", F.min("icl").over(w))
    return s.select("layer", "k", r6((F.col("icl") - F.col("best")) / F.abs("best"), "relative"), (F.col("stability") >= 0.40).alias("eligible"), (F.col("icl") <= F.col("best") * 1.01).alias("near"), (F.row_number().over(w.orderBy("icl", "k")) == 1).alias("selected"))


@query(sql("s AS (SELECT *, min(icl) OVER (PARTITION BY layer) AS best FROM scan), b AS (SELECT unnest([0.01, 0.1, 1.0])::DOUBLE AS b) SELECT layer, b, min(k) AS k FROM s, b WHERE icl - best <= b * 100 * 8 GROUP BY ALL", "scan"))
def m11_budget(spark, d):
    s = fx.scan(spark, d).withColumn("best", F.min("icl").over(Window.partitionBy("layer"))).withColumn("b", F.explode(F.array(F.lit(0.01), F.lit(0.1), F.lit(1.0))))
    return s.where(F.col("icl") - F.col("best") <= F.col("b") * 100 * 8).groupBy("layer", "b").agg(F.min("k").alias("k"))


@query(sql(CHOSEN + " SELECT DISTINCT layer, k2 AS k FROM (SELECT layer, unnest(range(k - 2, k + 3))::INT AS k2 FROM c) WHERE k2 >= 2 AND (layer, k2) NOT IN (SELECT (layer, k) FROM scan WHERE k % 2 = 0)", "scan"))
def m12_refinement(spark, d):
    near = _chosen(spark, d).select("layer", F.explode(F.sequence(F.col("k") - 2, F.col("k") + 2)).alias("k")).where("k >= 2").distinct()
    return near.join(fx.scan(spark, d).where("k % 2 = 0").select("layer", "k"), ["layer", "k"], "left_anti")


@query(sql(CHOSEN + " SELECT layer, round(avg(k), 6) AS mean_k, round(stddev_pop(k), 6) AS std_k, min(k) AS min_k, max(k) AS max_k FROM c GROUP BY layer", "scan"))
def m14_k_map(spark, d):
    return _chosen(spark, d).groupBy("layer").agg(r6(F.avg("k"), "mean_k"), r6(F.stddev_pop("k"), "std_k"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))


O = "(SELECT o_orderkey AS id, o_orderstatus AS s, " + uniform_sql("split", "o_orderkey") + " AS u FROM orders)"


def _dealt(spark, d):
    """Orders with their exact place in hash order: ranks over value ranges, not one window."""
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), uniform("split", F.col("o_orderkey")).alias("u")).withColumn("one", F.lit(1))
    return running(o, [], "u", {"rank": "one"}).join(o.agg(F.count("*").alias("n")))


@query(f"SELECT id, CASE WHEN i <= round(n * 0.7) THEN 'train' WHEN i <= round(n * 0.7) + round(n * 0.15) THEN 'val' ELSE 'test' END AS part FROM (SELECT id, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM {O})")
def p01_split(spark, d):
    n, i = F.col("n"), F.col("rank")
    return _dealt(spark, d).select("id", F.when(i <= F.round(n * 0.7), "train").when(i <= F.round(n * 0.7) + F.round(n * 0.15), "val").otherwise("test").alias("part"))


@query(f"SELECT id FROM {O} ORDER BY u LIMIT 500")
def p02_subsample(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), uniform("split", F.col("o_orderkey")).alias("u"))
    return o.orderBy("u").limit(500).select("id")


@query(f"SELECT id, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE (i - n % 7) // (n // 7) END::INT AS fold FROM (SELECT id, row_number() OVER (ORDER BY u) - 1 AS i, count(*) OVER () AS n FROM {O})")
def p03_kfold(spark, d):
    i, n = F.col("rank") - 1, F.col("n")
    small, more = F.floor(n / 7), n % 7
    return _dealt(spark, d).select("id", F.when(i < more * (small + 1), F.floor(i / (small + 1))).otherwise(F.floor((i - more) / small)).cast("int").alias("fold"))


@query(f"SELECT id, i <= greatest(1, round(0.2 * n)) AS held FROM (SELECT id, row_number() OVER (PARTITION BY s ORDER BY u) AS i, count(*) OVER (PARTITION BY s) AS n FROM {O})")
def p04_stratified(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), uniform("split", F.col("o_orderkey")).alias("u"), F.lit(1).alias("one"))
    ranked = running(o, ["s"], "u", {"rank": "one"}).join(o.groupBy("s").agg(F.count("*").alias("n")), "s")
    return ranked.select("id", (F.col("rank") <= F.greatest(F.lit(1), F.round(0.2 * F.col("n")))).alias("held"))


@query(f"SELECT id, i <= greatest(1, round(0.2 * n)) AS held FROM (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {uniform_sql('strata', 'o_orderkey')}) AS i, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders)")
def p04_joint_strata(spark, d):
    """The same within the strata of two attributes together."""
    by = ["o_orderstatus", "o_orderpriority"]
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *by)
    ranked = place(o, by, uniform("strata", F.col("id")), "rank").join(o.groupBy(*by).agg(F.count("*").alias("n")), by)
    return ranked.select("id", (F.col("rank") <= F.greatest(F.lit(1), F.round(0.2 * F.col("n")))).alias("held"))


@query(sql(f"g AS (SELECT sample, max(label) AS y, {uniform_sql('group', 'sample')} AS u FROM evt GROUP BY sample), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY u) AS i, count(*) OVER (PARTITION BY y) AS n FROM g) SELECT sample, token_end, CASE WHEN i <= round(n * 0.6) THEN 'train' WHEN i <= round(n * 0.8) THEN 'val' ELSE 'test' END AS part FROM k JOIN evt USING (sample)", "evt"))
def p05_grouped(spark, d):
    e = fx.evt(spark, d)
    g = e.groupBy("sample").agg(F.max("label").alias("y")).withColumns({"u": uniform("group", F.col("sample")), "one": F.lit(1)})
    k = running(g, ["y"], "u", {"i": "one"}).join(g.groupBy("y").agg(F.count("*").alias("n")), "y")
    part = F.when(F.col("i") <= F.round(F.col("n") * 0.6), "train").when(F.col("i") <= F.round(F.col("n") * 0.8), "val").otherwise("test")
    return e.join(k.select("sample", part.alias("part")), "sample").select("sample", "token_end", "part")


@query(sql("h AS (SELECT DISTINCT row_id, sha256('fold:' || row_id) AS x FROM emb), " + ", ".join(f"h{i + 1} AS (SELECT row_id, x, ({'r' if i else '0'} * {2**32 % 5} + ('0x' || substr(x, {8 * i + 1}, 8))::BIGINT) % 5 AS r FROM {'h' + str(i) if i else 'h'})" for i in range(8)) + " SELECT row_id, r::INT AS fold FROM h8", "emb"))
def p06_hash_folds(spark, d):
    return fx.emb(spark, d).select("row_id", fold("fold", F.col("row_id"), 5).alias("fold"))
