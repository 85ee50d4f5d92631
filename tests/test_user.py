"""User functions, interchange data sets and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerroutes.sources import tables as S
from layerroutes.sources import user as U


def rows(spark):
    return spark.createDataFrame([(i, f"k{i % 2}", [float(i), 1.0]) for i in range(25)], "row_id long, kind string, v array<double>").repartition(3)


def vectors(layer, frame):
    return np.stack(frame["v"].to_numpy()) * layer


def test_states_from_a_function(spark):
    got = U.states_from(rows(spark), [2, 5], vectors, fields=("kind",), width=2).collect()
    assert len(got) == 50 and all(r.x == [r.row_id * r.layer, float(r.layer)] and r.kind == f"k{r.row_id % 2}" for r in got)
    assert U.states_from(rows(spark).where("row_id < 0"), [1], vectors).count() == 0
    for bad in (lambda k, f: np.zeros((1, 2)), lambda k, f: np.zeros(len(f)), lambda k, f: np.full((len(f), 2), np.nan), lambda k, f: np.zeros((len(f), k))):
        with pytest.raises(Exception, match="layer"):
            U.states_from(rows(spark), [1, 2], bad, width=2).collect()
    with pytest.raises(ValueError):
        U.states_from(rows(spark), [1, 1], vectors)


def test_analyse_and_store(spark, tmp_path):
    f = lambda df: {"a": df.groupBy("kind").count(), "b": df.select("row_id")}
    got = U.analyse(rows(spark), f, str(tmp_path / "out"), "t1")
    assert {tuple(r) for r in got["a"].collect()} == {("k0", 13), ("k1", 12)} and got["b"].count() == 25
    assert U.analyse(rows(spark), lambda df: df.limit(3))["result"].count() == 3
    again = U.analyse(rows(spark).where("row_id < 4"), f, str(tmp_path / "out"), "t2")
    assert again["b"].count() == 4 and spark.read.parquet(str(tmp_path / "out" / "b")).count() == 29
    with pytest.raises(TypeError):
        U.analyse(rows(spark), lambda df: {"a": 3})
    with pytest.raises(ValueError):
        U.analyse(rows(spark), lambda df: df.select("kind", F.col("kind").alias("KIND")))
    with pytest.raises(ValueError):
        U.analyse(rows(spark), f, str(tmp_path / "x"))


def test_select_k(spark):
    scan = spark.createDataFrame([(layer, k, float((k - 3 - layer) ** 2)) for layer in (0, 1) for k in (5, 2, 3, 4)], "layer int, k int, cost double")
    assert {tuple(r) for r in U.select_k(scan, lambda f: f["k"][f["cost"].idxmin()]).collect()} == {(0, 3), (1, 4)}
    with pytest.raises(Exception, match="not tried"):
        U.select_k(scan, lambda f: 9).collect()


def arrays(spark, first=0, n=6):
    return spark.createDataFrame([(i, layer, [float(i), 2.0]) for layer in (0, 3) for i in range(first, first + n)], "row_id long, layer int, x array<double>")


def test_interchange_data_sets(spark, tmp_path):
    p = [str(tmp_path / c) for c in "abcd"]
    S.export_arrays(arrays(spark), p[0], ("m", "r1"), "prefix", "pre", "set")
    got, body = S.open_arrays(spark, p[0], [-1])
    assert {r.layer for r in got.collect()} == {3}
    assert body == {"format_version": 1, "model": ["m", "r1"], "layers": [0, 3], "rows": 6, "width": 2, "representation": "prefix", "final_norm": "pre", "dataset_id": "set"}
    for kw in ({"layers": [1]}, {"layers": [0, 0]}, {"model": ("m", "r2")}):
        with pytest.raises(ValueError):
            S.open_arrays(spark, p[0], **kw)
    with pytest.raises(ValueError):
        S.export_arrays(arrays(spark), str(tmp_path / "x"), ("m", ""))
    with pytest.raises(ValueError):
        S.export_arrays(arrays(spark).where("layer = 0 or row_id < 3"), str(tmp_path / "y"), ("m", "r"))
    S.export_arrays(arrays(spark, 6), p[1], ("m", "r1"), "prefix", "pre")
    assert S.same_source(spark, p[:2]).count() == 0
    S.export_arrays(arrays(spark, 10), p[2], ("m", "r2"), "prefix", "pre")
    S.export_arrays(arrays(spark, 50).where("layer = 0"), p[3], ("m", "r1"), "mean", "pre")
    assert {tuple(r) for r in S.same_source(spark, p).collect()} == {(p[2], "model"), (p[2], "row_id of another: 2"), (p[3], "layers"), (p[3], "representation")}


def test_inventory(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_bytes(b"hello")
    (tmp_path / "a.bin").write_bytes(b"\0")
    want = {("b.txt", 5, hashlib.sha256(b"hello").hexdigest()), ("a.bin", 1, hashlib.sha256(b"\0").hexdigest())}
    assert {tuple(r) for r in S.inventory(spark, str(tmp_path)).collect()} == want
