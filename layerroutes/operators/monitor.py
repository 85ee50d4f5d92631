"""Monitoring with a calibrated false-alarm rate. Rows are boundaries of responses: sample,
token_end, n_tokens, is_final, label (1 success) and score (danger)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.functions.stats import running


def far_threshold(bounds: DataFrame, far: float, final: bool = True) -> DataFrame:
    """One row: the value that leaves at most floor(far * n) of n successes strictly above, by
    their largest score. Without final boundaries, a response that has no other counts with a
    floor below all scores, so that it cannot alarm."""
    used = F.lit(True) if final else ~F.col("is_final")
    floor = bounds.agg((F.min("score") - 1e-9).alias("floor"))
    top = bounds.where("label = 1").groupBy("sample").agg(F.max(F.when(used, F.col("score"))).alias("m"))
    counts = top.join(floor).groupBy(F.coalesce("m", "floor").alias("m")).agg(F.count("*").alias("c"))  # one row joined
    n = counts.agg(F.sum("c").alias("n"))
    # the answer is where the running count over distinct maxima passes the index
    index = F.greatest(F.lit(0), F.col("n") - F.floor(F.lit(far) * F.col("n") + 1e-9) - 1)
    return running(counts, [], "m", {"run": "c"}).join(n).where(F.col("run") > index).agg(F.min("m").alias("threshold"))


def cases(bounds: DataFrame, threshold: Column, final: bool = True) -> DataFrame:
    """Per response: alarm (with ``final`` at any boundary, else before the final one, as the
    threshold was calibrated), early, saved share of tokens, score at the last boundary within
    half of the tokens, and final score."""
    over = F.col("score") > threshold
    early = over & ~F.col("is_final")
    g = bounds.groupBy("sample").agg(
        F.max("label").alias("label"), F.max((over if final else early).cast("int")).alias("alarm"), F.min(F.when(early, F.col("token_end"))).alias("first_early"), F.max("n_tokens").alias("n_tokens"),
        F.max_by("score", F.when(F.col("token_end") <= 0.5 * F.col("n_tokens"), F.col("token_end"))).alias("half_score"), F.max(F.when(F.col("is_final"), F.col("score"))).alias("final_score"),
        F.max((~F.col("is_final")).cast("int")).alias("covered"),
    )
    return g.withColumns({"early": F.col("first_early").isNotNull(), "saved": F.coalesce(1 - F.col("first_early") / F.col("n_tokens"), F.lit(0.0))})


def metrics(c: DataFrame) -> DataFrame:
    fail, ok = F.col("label") == 0, F.col("label") == 1
    rate = lambda when, what: F.avg(F.when(when, what.cast("double")))
    return c.agg(F.count("*").alias("n"), rate(ok, F.col("alarm")).alias("far"), rate(fail, F.col("alarm")).alias("detected"), rate(fail, F.col("early").cast("int")).alias("early"), rate(fail, F.col("saved")).alias("saved"), F.avg("saved").alias("saved_all"), F.avg("covered").alias("coverage"), F.avg(F.col("half_score").isNotNull().cast("int")).alias("half_coverage"))


def baselines(rows: DataFrame, methods: list[tuple[str, str, int]], far: float, held: Column, final: bool = False) -> DataFrame:
    """Frozen baselines on boundaries: for (name, column, sign), the prefix mean of the column
    times the sign is the danger; its threshold comes from rows where ``held`` is false, its
    metrics from the others. A method whose column is not there is listed, not filled in."""
    w = Window.partitionBy("sample").orderBy("token_end").rowsBetween(Window.unboundedPreceding, 0)
    out = None
    for name, column, sign in methods:
        if column not in rows.columns:
            part = rows.sparkSession.createDataFrame([(name, "unavailable")], "method string, status string")
        else:
            b = rows.withColumn("score", sign * F.avg(column).over(w))
            c = cases(b.where(held).join(far_threshold(b.where(~held), far, final)), F.col("threshold"), final)
            part = metrics(c).withColumns({"method": F.lit(name), "status": F.lit("measured")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
