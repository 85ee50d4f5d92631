"""Distances and assignment to centres."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A


def nearest(states: DataFrame, centers: DataFrame, metric: str = "euclid", cosine_ties: str = "state") -> DataFrame:
    """``states(layer, x, ...)`` with the nearest of ``centers(layer, state, mu)``: state, dist
    (squared Euclid, or one minus cosine), second (the next distance, null with one centre).

    A layer's centres become one array, so assignment is an expression on each row: no shuffle
    of states, whatever their number."""
    per_layer = centers.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("state", "mu"))).alias("_cs"))  # K a layer
    d = (lambda x, m: A.sq_dist(x, m)) if metric == "euclid" else (lambda x, m: 1 - A.cosine(x, m))
    ranked = F.array_sort(F.transform("_cs", lambda c: F.struct(d(F.col("x"), c["mu"]).alias("d"), c["state"].alias("state"), c["mu"].alias("mu"))))
    out = states.join(per_layer, "layer").withColumn("_r", ranked).drop("_cs")
    first, other = F.col("_r")[0], F.get(F.col("_r"), F.lit(1))
    return out.withColumns({"state": first["state"], "dist": first["d"], "mu": first["mu"], "second": other["d"]}).drop("_r")


SHARES = 64


def met(rows: DataFrame, queries: DataFrame, by: list[str], ident: str) -> DataFrame:
    """All pairs of a row and a query that agree on ``by``. Rows are dealt over shares by the
    hash of ``ident`` and every share gets the queries, so that a group's pairs are spread over
    tasks whatever its size, and a task reads rows and queries but holds no pairs."""
    parts = 2 * SHARES
    left = rows.withColumn("_share", F.pmod(F.xxhash64(ident), F.lit(SHARES)).cast("int"))
    right = queries.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    keys = [*by, "_share"]
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys).drop("_share")


def gaussian_log_joint(states: DataFrame, model: DataFrame) -> DataFrame:
    """Log joint density of each row and component of a diagonal mixture ``model(layer, state,
    weight, mu, var)``: rows (..., state, lj)."""
    terms = F.zip_with(F.zip_with("x", "mu", lambda a, m: (a - m) * (a - m)), "var", lambda e, v: e / v + F.log(F.lit(6.283185307179586) * v))
    return states.join(F.broadcast(model), "layer").withColumn("lj", F.log("weight") - 0.5 * A.total(terms))  # K rows a layer


def responsibilities(joint: DataFrame, keys: list[str]) -> DataFrame:
    """Log density and responsibilities by log-sum-exp: rows (keys, state, resp, logp)."""
    top = joint.groupBy(*keys).agg(F.max("lj").alias("_m"))
    full = joint.join(top, keys)
    logp = full.groupBy(*keys).agg((F.first("_m") + F.log(F.sum(F.exp(F.col("lj") - F.col("_m"))))).alias("logp"))
    return joint.join(logp, keys).withColumn("resp", F.exp(F.col("lj") - F.col("logp")))
