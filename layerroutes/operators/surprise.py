"""Label-free route scores by leave-fold-out counts: totals minus the own fold's."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cross_fitted(routes: DataFrame, folds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Per row: mean node surprise and mean edge surprise in nats, with counts of the other
    folds only; the vocabulary of a layer is that of all rows."""
    r = routes.join(folds, "row_id")
    k = routes.groupBy("layer").agg(F.countDistinct("state").alias("k"))

    def held(df: DataFrame, keys: list[str]) -> DataFrame:
        own = df.groupBy(*keys, "fold").agg(F.count("*").alias("own"))
        every = own.groupBy(*keys).agg(F.sum("own").alias("every"))
        nf = folds.select("fold").distinct()
        return every.join(nf).join(own, [*keys, "fold"], "left").select(*keys, "fold", (F.col("every") - F.coalesce("own", F.lit(0))).alias("c"))

    node, total = held(r, ["layer", "state"]), held(r, ["layer"]).withColumnRenamed("c", "n")
    s = r.join(node, ["layer", "state", "fold"]).join(total, ["layer", "fold"]).join(k, "layer")
    nodes = s.groupBy("row_id").agg(F.avg(-F.log((F.col("c") + alpha) / (F.col("n") + alpha * F.col("k")))).alias("node"))
    w = Window.partitionBy("row_id").orderBy("layer")
    e = r.select("row_id", "fold", "layer", F.col("state").alias("i"), F.lead("layer").over(w).alias("to"), F.lead("state").over(w).alias("j")).where("to is not null")
    pair, src = held(e, ["layer", "i", "j"]), held(e, ["layer", "i"]).withColumnRenamed("c", "n")
    t = e.join(pair, ["layer", "i", "j", "fold"]).join(src, ["layer", "i", "fold"]).join(k.select(F.col("layer").alias("to"), "k"), "to")
    edges = t.groupBy("row_id").agg(F.avg(-F.log((F.col("c") + alpha) / (F.col("n") + alpha * F.col("k")))).alias("edge"))
    return nodes.join(edges, "row_id")


def count_bayes(routes: DataFrame, alpha: float = 1.0, smooth_prior: bool = False) -> DataFrame:
    """Log posterior odds ingredients of a count model per layer: (layer, state, y, logp) and
    the prior, over the grid of each layer's vocabulary and the classes."""
    c = routes.groupBy("layer", "state", "label").agg(F.count("*").alias("n"))
    vocab, classes = c.select("layer", "state").distinct(), c.select("label").distinct()
    grid = vocab.crossJoin(classes).join(c, ["layer", "state", "label"], "left").fillna(0, ["n"])
    w = Window.partitionBy("layer", "label")
    return grid.withColumn("logp", F.log((F.col("n") + alpha) / (F.sum("n").over(w) + alpha * F.count("*").over(w))))
