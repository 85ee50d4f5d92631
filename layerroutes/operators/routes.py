"""Trajectory tables over long routes (row_id, layer, state, ...)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.functions.stats import entropy_bits


def to_global(local: DataFrame, vocab: DataFrame) -> DataFrame:
    """Local states to global ones; -1 for a local state outside the vocabulary."""
    return local.join(F.broadcast(vocab), ["layer", "local_state"], "left").withColumn("state", F.coalesce("state", F.lit(-1)))  # K rows a layer


def steps(routes: DataFrame, *keep: str) -> DataFrame:
    """Adjacent layers of each row: layer_from, layer_to, state_from, state_to; -1 left out."""
    w = Window.partitionBy("row_id").orderBy("layer")
    n = routes.select("row_id", F.col("layer").alias("layer_from"), F.lead("layer").over(w).alias("layer_to"), F.col("state").alias("state_from"), F.lead("state").over(w).alias("state_to"), *keep)
    return n.where("layer_to is not null and state_from >= 0 and state_to >= 0")


EDGE = ["layer_from", "layer_to", "state_from", "state_to"]


def transitions(routes: DataFrame) -> DataFrame:
    return steps(routes).groupBy(*EDGE).agg(F.count("*").alias("n"))


def with_share(edges: DataFrame, by: list[str], name: str = "prob") -> DataFrame:
    return edges.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def births_deaths(edges: DataFrame, min_count: int = 1) -> DataFrame:
    """Births: targets of layer_from that are no sources there, at the next layer; deaths:
    sources that are no targets, at layer_from. The count is tested after the difference."""
    to = edges.groupBy("layer_from", F.col("state_to").alias("state")).agg(F.max("layer_to").alias("layer"), F.sum("n").alias("n"))
    out = edges.groupBy("layer_from", F.col("state_from").alias("state")).agg(F.sum("n").alias("n")).withColumn("layer", F.col("layer_from"))
    births = to.join(out.select("layer_from", "state"), ["layer_from", "state"], "left_anti").select(F.lit("birth").alias("kind"), "layer", "state", "n")
    deaths = out.join(to.select("layer_from", "state"), ["layer_from", "state"], "left_anti").select(F.lit("death").alias("kind"), "layer", "state", "n")
    return births.union(deaths).where(F.col("n") >= min_count)


def splits_merges(edges: DataFrame, min_prob: float = 0.05, min_total: int = 20) -> DataFrame:
    """States with two or more branches: splits at the earlier layer, merges at the later."""
    out = []
    for kind, own, other in (("split", "state_from", "state_to"), ("merge", "state_to", "state_from")):
        by = ["layer_from", "layer_to", own]
        p = with_share(edges, by).withColumn("total", F.sum("n").over(Window.partitionBy(*by))).where((F.col("prob") >= min_prob) & (F.col("total") >= min_total))
        g = p.groupBy(F.col("layer_from" if kind == "split" else "layer_to").alias("layer"), F.col(own).alias("state")).agg(F.count("*").alias("branches"), F.array_join(F.sort_array(F.collect_list(other)), ",").alias("targets"), F.max("prob").alias("max_prob"))  # at most K
        out.append(g.where("branches >= 2").select(F.lit(kind).alias("kind"), "*"))
    return out[0].union(out[1])


def nodes(routes: DataFrame) -> DataFrame:
    """Count, frequency, rank by count (then state) from the middle, out-entropy in bits, label
    mean and its difference to the whole."""
    e = transitions(routes)
    out = with_share(e, ["layer_from", "state_from"]).groupBy(F.col("layer_from").alias("layer"), F.col("state_from").alias("state")).agg(F.sum(entropy_bits(F.col("prob"))).alias("out_entropy"))
    base = routes.agg(F.avg("label").alias("base"))
    n = routes.where("state >= 0").groupBy("layer", "state").agg(F.count("*").alias("n"), F.avg("label").alias("label_mean"))
    w = Window.partitionBy("layer")
    n = n.withColumns({"freq": F.col("n") / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "state")) - (F.count("*").over(w) + 1) / 2})
    return n.join(out, ["layer", "state"], "left").join(base).select("layer", "state", "n", "freq", "rank", F.coalesce("out_entropy", F.lit(0.0)).alias("out_entropy"), "label_mean", (F.col("label_mean") - F.col("base")).alias("delta"))


def edges_with_label(routes: DataFrame) -> DataFrame:
    s = steps(routes, "label")
    base = routes.agg(F.avg("label").alias("base"))
    e = s.groupBy(*EDGE).agg(F.count("*").alias("n"), F.avg("label").alias("label_mean"))
    e = with_share(with_share(e, ["layer_from", "state_from"]), ["layer_from"], "freq")
    return e.join(base).select(*EDGE, "n", "prob", "freq", "label_mean", (F.col("label_mean") - F.col("base")).alias("delta"))


def hamming(routes: DataFrame, sample: DataFrame) -> DataFrame:
    """Share of equal layers for pairs of sampled rows; the sample is a parameter's size."""
    r = routes.join(sample.select("row_id"), "row_id", "left_semi").select("row_id", "layer", "state")
    n = r.groupBy("row_id").agg(F.count("*").alias("layers"))
    b = r.select(F.col("row_id").alias("other"), "layer", "state")
    eq = r.join(b, ["layer", "state"]).where("row_id < other").groupBy("row_id", "other").agg(F.count("*").alias("same"))
    return eq.join(n, "row_id").select("row_id", "other", (F.col("same") / F.col("layers")).alias("similarity"))


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cells of two attributes with zero cells: (by, a, b, n, row, col, total). Levels of both
    are few; the grid is built of them, not of rows."""
    by = by or []
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    la, lb = cells.select(*by, a).distinct(), cells.select(*by, b).distinct()
    grid = la.join(lb, by) if by else la.crossJoin(lb)
    full = grid.join(cells, [*by, a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumns({"row": F.sum("n").over(Window.partitionBy(*by, a)), "col": F.sum("n").over(Window.partitionBy(*by, b)), "total": F.sum("n").over(Window.partitionBy(*by))})


def association(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Chi-square without correction, degrees of freedom, Cramer's V, least expected count and
    share of expected counts under 5."""
    by = by or []
    c = contingency(df, a, b, by).withColumn("e", F.col("row") * F.col("col") / F.col("total"))
    g = c.groupBy(*by).agg(
        F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("chi2"), F.countDistinct(a).alias("ra"), F.countDistinct(b).alias("rb"),
        F.min("e").alias("min_expected"), F.avg((F.col("e") < 5).cast("double")).alias("share_under_5"), F.max("total").alias("n"),
    )
    least = F.least("ra", "rb") - 1
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.when(least > 0, least)))
    return g.select(*by, "chi2", ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("dof"), v.alias("cramers_v"), "min_expected", "share_under_5", "n")
