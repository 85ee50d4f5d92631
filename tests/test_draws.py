"""Poisson draws by hash: those of the uniform number, made once for each row and step."""

import math

from pyspark.sql import functions as F

from layerroutes.functions.hashing import POISSON, poisson, uniform
from layerroutes.functions.stats import drawn_place
from layerroutes.operators import nulls
from layerroutes.plans.catalog import QUERIES


def test_poisson_counts_the_steps_of_the_uniform_number(spark):
    df = spark.range(20000).select(uniform("s", F.col("id")).alias("u"), poisson("s", F.col("id")).alias("w"))
    rows = df.collect()
    assert all(r.w == sum(r.u >= c for c in POISSON) for r in rows)
    assert abs(sum(r.w for r in rows) / len(rows) - 1) < 0.03


def test_group_draws_are_made_once_a_group(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "t", "en", "s", 100 + i * 37 % 4000) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2) for i in range(2000)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    import layerroutes.plans.studies as studies

    counted, real = spark.sparkContext.accumulator(0), studies.poisson

    def watched(salt, *ids):
        text = F.concat_ws("|", F.lit(salt), *(i.cast("string") for i in ids))
        mark = F.udf(lambda t: counted.add(1) or t, "string")
        return real(salt, *ids) + F.length(mark(text)) * 0

    monkeypatch.setattr(studies, "poisson", watched)
    row = QUERIES["e07_cluster_bootstrap"](spark, str(tmp_path)).first()
    assert all(math.isfinite(v) for v in row) and row.auc_low < row.auc_high
    assert 0 < counted.value < 2000 * 100 / 5


def test_drawn_place_is_the_rank_of_the_uniform_number(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id")
    rows = drawn_place(df, ["g"], "deal", ["g", "id"], "k").withColumn("u", uniform("deal", F.col("g"), F.col("id"))).collect()
    for g in range(3):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.u)
        assert [r.k for r in mine] == list(range(1, 1001))


def test_replicates_deal_as_single_ones_do(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").alias("row_id"), (F.col("id") % 7).alias("v"))
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = lambda t: sorted((r.g, r.rep, r.row_id, r.v) for r in t.collect())
    assert key(nulls.shuffled(df, ["g"], "row_id", "v", "deal", 3)) == key(nulls.shuffled(each, ["g", "rep"], "row_id", "v", "deal"))


def test_exact_mean_of_large_cells_sums_only_near_their_centre(spark):
    n = 40000  # labels and destinations independent: expected close to (2 - 1) / (2 ln 2 n) bits a row
    steps = spark.range(n).select(F.lit(0).alias("layer"), F.lit(0).alias("i"), (F.col("id") % 2).alias("dest"), (F.floor(F.col("id") / 2) % 2).cast("int").alias("label"))
    plan = nulls.exact_mean(steps, ["layer"], ["i"])
    assert abs(plan.first()["mean"] - 1 / (2 * math.log(2) * n)) < 1e-8


def test_dealt_rows_are_not_broadcast(spark, tmp_path):
    spark.range(20000).select((F.col("id") % 2).alias("g"), F.col("id").alias("row_id"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/rows")  # small in its file, 9 times as many when dealt
    rows = spark.read.parquet(f"{tmp_path}/rows")
    for dealt in (nulls.shuffled(rows, ["g"], "row_id", "v", "deal", 9), nulls.shuffled(rows, ["g"], "row_id", "v", "deal")):
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "_rank" in line]
        assert joins and not [line for line in joins if "Broadcast" in line]
