"""Rounded vectors against SQL where entries are small and negative."""

import duckdb
import pytest
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    v = lambda i: [-1e-7 if (i + k) % 5 == 0 else (-0.25 if k % 3 else 0.5) + (k // 8) * -1e-7 for k in range(64)]
    rows = [(i, v(i), i % 3) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name, column", [("s04_layers", "x"), ("t03_l2_normalise", "u"), ("u07_final_swap", "x"), ("u09_layer_change", "change")])
def test_small_negative_numbers_keep_their_sign(spark, small, name, column):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(f"SELECT row_id, layer, {column} FROM ({ORACLES[name]})").fetchall()))
    got = sorted(repr((r[0], r[1], list(r[2]))) for r in QUERIES[name](spark, small).select("row_id", "layer", column).collect())
    assert any("-0.0" in r.replace("-0.0000", "") for r in want)
    assert got == want


def test_signed_round(spark):
    values = [0.0, -0.0, -4e-7, 4e-7, -5e-7, 1 / 128, -1 / 128, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [0.0, -0.0, -0.0, 0.0, -1e-6, 0.007813, -0.007813, float("inf"), float("-inf"), float("nan"), None]
    assert [repr(r[0]) for r in df.select(A.signed_round(F.col("v"))).collect()] == [repr(v) for v in want]
