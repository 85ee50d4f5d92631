"""Pairs of a query set with all rows: dealt over tasks, compiled distances, ranks by counting."""

import random

from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.operators import distances
from layerroutes.plans.catalog import QUERIES


def test_one_groups_pairs_are_spread_over_tasks(spark):
    s = spark.range(2000).select(F.lit(7).alias("layer"), F.col("id").alias("row_id"))
    q = s.where("row_id % 100 = 0").withColumnRenamed("row_id", "anchor")
    p = distances.met(s, q, ["layer"], "row_id")
    counts = [r.n for r in p.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 2000 * 20 and max(counts) < 2000 * 20 / 8


def test_near_round_is_round(spark):
    values = [0.0, -1e-17, 5e-7, 1.5e-6, 0.1234565, 2.0000005, 1.0000005, -0.1234565, 1e300, -7.25, float("nan"), None]
    values += [random.Random(1).uniform(-2, 2) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(A.near_round(F.col("v")).alias("a"), F.round("v", 6).alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]


def test_neighbour_audit_ranks_by_distance_and_id(spark, tmp_path):
    draw = random.Random(3)  # coarse values, so that distances tie
    x = {i: [float(draw.randrange(3)) for _ in range(64)] for i in range(0, 1500, 2)}
    spark.createDataFrame([(i, v, 0) for i, v in x.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.anchor: (r.shared, r.penalty) for r in QUERIES["g15_neighbour_audit"](spark, str(tmp_path)).collect()}
    for a in (i for i in x if i % 100 == 0):
        gap = lambda b, n, a=a: (sum((p - q) ** 2 for p, q in zip(x[a][56 : 56 + n], x[b][56 : 56 + n])), b)
        others = [b for b in x if b != a]
        whole = {b: r for r, b in enumerate(sorted(others, key=lambda b: gap(b, 8)), 1)}
        near = [whole[b] for b in sorted(others, key=lambda b: gap(b, 2))[:5]]
        assert got.pop(a) == (sum(r <= 5 for r in near), sum(max(r - 5, 0) for r in near))
    assert not got
