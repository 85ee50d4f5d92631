"""Class models of routes: log-odds of label 1 over label 0. Counts come from training rows;
scores are joins with tables of states or pairs of states."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.operators.routes import steps


def _counts(rows: DataFrame, keys: list[str], tag: str = "c") -> DataFrame:
    one = F.col("label") == 1
    return rows.groupBy(*keys).agg(F.count(F.when(one, 1)).alias(f"{tag}1"), F.count(F.when(~one, 1)).alias(f"{tag}0"))


def _odds(size: Column, alpha: float) -> Column:
    lp = lambda y: F.log((F.coalesce(f"c{y}", F.lit(0)) + alpha) / (F.coalesce(f"n{y}", F.lit(0)) + alpha * size))
    return lp(1) - lp(0)


def _prior(train: DataFrame, alpha: float) -> DataFrame:
    y = train.select("row_id", "label").distinct()
    return y.agg(F.log((F.sum("label") + alpha) / (F.sum(1 - F.col("label")) + alpha)).alias("prior"))


def states(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Naive Bayes over one global vocabulary of states 0 to the greatest trained one. Other
    states, and negative ones, say nothing."""
    seen = train.where("state >= 0")
    size = seen.agg((F.max("state") + 1).alias("s"))  # one row
    n = _counts(seen, ["layer"], "n")
    x = test.join(size).where((F.col("state") >= 0) & (F.col("state") < F.col("s"))).join(n, "layer").join(_counts(seen, ["layer", "state"]), ["layer", "state"], "left")
    own = x.groupBy("row_id").agg(F.sum(_odds(F.col("s"), alpha)).alias("w"))
    all_ = test.select("row_id").distinct().join(own, "row_id", "left").join(_prior(train, alpha))
    return all_.select("row_id", (F.coalesce("w", F.lit(0.0)) + F.col("prior")).alias("log_odds"))


def markov(train: DataFrame, test: DataFrame, sizes: DataFrame, alpha: float = 1.0, prior_alpha: float = 1.0) -> DataFrame:
    """First-order Markov chains of the classes, with tables for each layer. sizes: (layer,
    size) of the layers' vocabularies."""
    first = train.where("state >= 0").join(sizes.agg(F.min("layer").alias("layer")), "layer")
    at = test.where("state >= 0").join(first.select("layer").distinct(), "layer").join(sizes, "layer")
    start = at.join(_counts(first, ["layer"], "n"), "layer", "left").join(_counts(first, ["layer", "state"]), ["layer", "state"], "left").select("row_id", _odds(F.col("size"), alpha).alias("w"))
    pair = ["layer_from", "state_from"]
    edges = steps(train, "label").where("state_from >= 0 and state_to >= 0")
    walk = steps(test, "label").where("state_from >= 0 and state_to >= 0").join(sizes.select(F.col("layer").alias("layer_to"), "size"), "layer_to")
    walk = walk.join(_counts(edges, pair, "n"), pair, "left").join(_counts(edges, [*pair, "state_to"]), [*pair, "state_to"], "left").select("row_id", _odds(F.col("size"), alpha).alias("w"))
    own = start.union(walk).groupBy("row_id").agg(F.sum("w").alias("w"))
    all_ = test.select("row_id").distinct().join(own, "row_id", "left").join(_prior(train, prior_alpha))
    return all_.select("row_id", (F.coalesce("w", F.lit(0.0)) + F.col("prior")).alias("log_odds"))


def backoff_losses(train: DataFrame, test: DataFrame, order: int = 2, strength: float = 10.0, alpha: float = 1.0) -> DataFrame:
    """Rows (row_id, layer, loss): minus log of the state's probability given the states before
    it, each order leaning on the one below by ``strength`` counts."""
    w = Window.partitionBy("row_id").orderBy("layer")
    lagged = lambda f: f.select("row_id", "layer", "state", *(F.lag("state", k).over(w).alias(f"s{k}") for k in range(1, order + 1)))
    tr, x = lagged(train), lagged(test)
    sizes = train.unionByName(test).groupBy("layer").agg(F.countDistinct("state").alias("k"))
    n = tr.groupBy("layer").agg(F.count("*").alias("n")).join(sizes, "layer")
    x = x.join(n, "layer").join(tr.groupBy("layer", "state").agg(F.count("*").alias("c")), ["layer", "state"], "left")
    x = x.withColumn("p", (F.coalesce("c", F.lit(0)) + alpha) / (F.col("n") + alpha * F.col("k"))).drop("n", "k", "c")
    for m in range(1, order + 1):
        keys = ["layer", *(f"s{k}" for k in range(1, m + 1))]
        known = tr.where(F.col(f"s{m}").isNotNull())
        x = x.join(known.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").join(known.groupBy(*keys, "state").agg(F.count("*").alias("c")), [*keys, "state"], "left")
        deeper = (F.coalesce("c", F.lit(0)) + strength * F.col("p")) / (F.coalesce("n", F.lit(0)) + strength)
        x = x.withColumn("p", F.when(F.col(f"s{m}").isNotNull(), deeper).otherwise(F.col("p"))).drop("n", "c")
    return x.select("row_id", "layer", (-F.log(F.greatest("p", F.lit(1e-30)))).alias("loss"))
