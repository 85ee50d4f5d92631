"""Queries of single channels: effects, repeats, controls."""

from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.operators import channels as C
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql
from layerroutes.plans.registry import query

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)


def rows(spark, d):
    """Discovery rows are three of five; a test row is clean if its response was not cut."""
    s = fx.states(spark, d).join(fx.emb(spark, d), "row_id")
    return s.select("row_id", "layer", "x", F.col("label").alias("y"), (F.col("row_id") % 5 < 3).alias("train"), (F.col("finish_reason") != "length").alias("clean"), "category", "level", "n_tokens")


_ROWS = "r AS (SELECT row_id, layer, label AS y, row_id % 5 < 3 AS train, finish_reason <> 'length' AS clean, level, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 8) AS size, i - 1 AS channel, x[i] AS v FROM states JOIN emb USING (row_id), range(1, 9) t(i))"


def _d(v: str, when: str) -> str:
    n1, n0 = (f"count(*) FILTER ({when} AND y = {y})" for y in (1, 0))
    m1, m0 = (f"avg({v}) FILTER ({when} AND y = {y})" for y in (1, 0))
    v1, v0 = (f"var_samp({v}) FILTER ({when} AND y = {y})" for y in (1, 0))
    return f"({m1} - {m0}) / sqrt((({n1} - 1) * {v1} + ({n0} - 1) * {v0}) / ({n1} + {n0} - 2))"


_TABLE = f"""{_ROWS}, g AS (SELECT layer, channel, sqrt(avg(v * v) FILTER (train)) AS rms, max(abs(v)) FILTER (train) AS peak, {_d('v', 'train')} AS dd, {_d('v', 'NOT train')} AS dt, {_d('v', 'NOT train AND clean')} AS dc, {_d('v / size', 'NOT train')} AS du FROM r GROUP BY ALL),
 k AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY rms) / 8.0 AS share, peak / median(rms) OVER (PARTITION BY layer) AS ratio FROM g)"""


@query(sql(_TABLE + " SELECT layer, channel, round(rms, 6) AS rms, round(share, 6) AS rms_share, round(ratio, 6) AS peak_ratio, share BETWEEN 0.25 AND 0.75 AND ratio < 10 AS middle, round(dd, 6) AS discovery_d, round(dt, 6) AS test_d, round(dc, 6) AS clean_d, round(du, 6) AS unit_d FROM k", "states", "emb"))
def e14_channels(spark, d):
    t = C.channel_table(rows(spark, d))
    return t.select("layer", F.col("channel").cast("long").alias("channel"), *(r6(c) for c in ("rms", "rms_share", "peak_ratio")), "middle", *(r6(f"{n}_d") for n in ("discovery", "test", "clean", "unit")))


@query(sql(f"{_ROWS} SELECT layer, channel, level, round({_d('v', 'true')}, 6) AS d, count(*) AS n FROM r WHERE NOT train GROUP BY ALL", "states", "emb"))
def e14_categories(spark, d):
    """Effects on the test rows of each level, in all channels."""
    x = rows(spark, d)
    every = x.select("layer").distinct().withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(fx.WIDTH - 1))))
    return C.per_category(x, every, "level").select("layer", F.col("channel").cast("long").alias("channel"), "level", r6("d"), "n")


@query(sql(f"{_ROWS}, s AS (SELECT row_id, channel, v AS v0 FROM r WHERE layer = 0) SELECT layer, channel, round({_d('v', 'true')}, 6) AS d, round(corr(v0, v), 6) AS r, count(*) AS n FROM r JOIN s USING (row_id, channel) WHERE NOT train GROUP BY ALL", "states", "emb"))
def e14_over_layers(spark, d):
    """Channels of the first layer followed through the others."""
    x = rows(spark, d)
    every = x.where("layer = 0").select("layer").distinct().withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(fx.WIDTH - 1))))
    return C.over_layers(x, every, 0).select("layer", F.col("channel").cast("long").alias("channel"), r6("d"), r6("r"), "n")


@query(sql(f"{_ROWS}, u AS (SELECT a.layer, a.channel, a.y, a.v - b.v AS u, a.v FROM r a JOIN r b ON a.row_id = b.row_id AND a.channel = b.channel AND a.layer = b.layer + 1 WHERE NOT a.train), g AS (SELECT layer, channel, avg(u) FILTER (y = 1) - avg(u) FILTER (y = 0) AS delta, 1.96 * sqrt(var_samp(u) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(u) FILTER (y = 0) / count(*) FILTER (y = 0)) AS half, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS sd FROM u GROUP BY ALL) SELECT layer, channel, round(delta, 6) AS delta, round(delta - half, 6) AS low, round(delta + half, 6) AS high, round(sd, 6) AS state_delta FROM g", "states", "emb"))
def e14_updates(spark, d):
    """Class differences of layer updates."""
    x = rows(spark, d)
    every = x.where("layer = 0").select("layer").distinct().withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(fx.WIDTH - 1))))
    return C.updates(x, every, 0).select("layer", F.col("channel").cast("long").alias("channel"), *(r6(c) for c in ("delta", "low", "high", "state_delta")))


@query()
def e14_controlled(spark, d):
    """Correlations with the label beyond level, length and vector size."""
    size = F.log(F.greatest(F.sqrt(A.dot(F.col("x"), F.col("x")) / F.size("x")), F.lit(1e-12)))
    level = [(F.col("level") == v).cast("double") for v in range(2, 6)]
    c = C.controlled(rows(spark, d), F.array(*level, F.log1p("n_tokens"), size))
    return c.select("layer", "channel", *(F.round(n, 5).alias(n) for n in ("discovery_r", "discovery_p", "test_r", "test_p")))


@query()
def e14_chosen(spark, d):
    """The four middle channels a layer that stand out on discovery rows, with their repeats."""
    t = C.channel_table(rows(spark, d))
    return t.join(C.chosen(t, 4), ["layer", "channel"]).select("layer", "channel", *(F.round(f"{n}_p", 5).alias(f"{n}_p") for n in ("discovery", "test", "clean", "unit")))
