"""Cross-fitted conditional models against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerroutes.operators import conditional as C


def recursive(x, low, high, knots):
    """B-splines by the recursion over knots that go on evenly past both ends."""
    h = (high - low) / (knots - 1)
    t = low + h * np.arange(-3, knots + 3)
    x = np.clip(x, low, high)
    b = [((t[i] <= x) & (x < t[i + 1])).astype(float) for i in range(len(t) - 1)]
    for k in range(1, 4):
        b = [(x - t[i]) / (t[i + k] - t[i]) * b[i] + (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * b[i + 1] for i in range(len(b) - 1)]
    return np.stack(b[: knots + 1], -1)


def test_splines(spark):
    x = [-5.0, 0.0, 0.3, 1.0, 2.49, 2.5, 7.7, 9.999, 10.0, 12.0]
    got = [r.b for r in spark.createDataFrame([(v,) for v in x], "x double").select(C.cubic_splines(F.col("x"), 0.0, 10.0).alias("b")).collect()]
    assert np.allclose(got, recursive(np.array(x), 0.0, 10.0, 5))
    flat = spark.createDataFrame([(3.0,)], "x double").select(C.cubic_splines(F.col("x"), 3.0, 3.0).alias("b")).first().b
    assert np.isfinite(flat).all()


def frame(spark):
    g = np.random.default_rng(3)
    n = 150
    kind, v = g.choice(["a", "b", "c"], n), g.normal(size=n)
    y = (g.random(n) < 1 / (1 + np.exp(-(2 * v + (kind == "a"))))).astype(int)
    noise = g.normal(size=n)
    rows = [(i, int(y[i]), str(kind[i]), float(v[i]), float(noise[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, label int, kind string, v double, noise double").repartition(3)


def test_folds_are_stratified(spark):
    rows, df = frame(spark)
    c = {(r.label, r.fold): r["count"] for r in C.stratified_folds(df, "row_id", "label", 4, "s").groupBy("label", "fold").count().collect()}
    for y in (0, 1):
        n = [c[y, f] for f in range(4)]
        assert max(n) - min(n) <= 1 and sum(n) == sum(r[1] == y for r in rows)


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w))
    keep[0, 0] = 0  # the intercept carries no penalty
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (p - y) + keep @ w)
    return w


def test_scores_come_from_the_other_folds(spark):
    rows, df = frame(spark)
    configs = {"noise": ["noise"], "both": ["noise", "v"]}
    scored = C.cross_fitted(df, "row_id", "label", ["kind"], configs, 3).cache()
    got = {(r.row_id, r.config): (r.fold, r.p) for r in scored.collect()}
    assert len(got) == 300
    by = {r[0]: r for r in rows}
    for name, numbers in configs.items():
        for fold in range(3):
            test = [i for i in by if got[i, name][0] == fold]
            train = [i for i in by if i not in set(test)]
            levels = sorted({by[i][2] for i in train})

            def terms(ids):
                cols = [np.array([[by[i][2] == v for v in levels] for i in ids], float)]
                for n in numbers:
                    at = {"v": 3, "noise": 4}[n]
                    own = [by[i][at] for i in train]
                    cols.append(recursive(np.array([by[i][at] for i in ids]), min(own), max(own), 5))
                return np.column_stack(cols)

            w = newton(terms(train), np.array([by[i][1] for i in train]))
            p = 1 / (1 + np.exp(-(w[0] + terms(test) @ w[1:])))
            assert np.allclose([got[i, name][1] for i in test], p, atol=1e-6)
    table = {r.config: r for r in C.compared(scored, "label", "noise").collect()}
    assert table["noise"].auroc_gain == 0 and table["both"].auroc_gain > 0.1 and table["both"].loss_gain < -0.05
    p = np.clip([got[i, "both"][1] for i in by], 1e-15, 1)
    y = np.array([by[i][1] for i in by])
    assert table["both"].log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def test_trees_and_unknown_levels(spark):
    rows, df = frame(spark)
    rare = df.unionByName(spark.createDataFrame([(999, 1, "only", 0.0, 0.0)], df.schema))
    s = C.cross_fitted(rare, "row_id", "label", ["kind"], {"v": ["v"]}, 2, "trees").collect()
    assert len(s) == 151 and all(0 <= r.p <= 1 for r in s)
