"""Channel tables against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerroutes.functions.stats import log_gamma, t_two_sided
from layerroutes.operators import channels as C

rng = np.random.default_rng(12)
N, D = 160, 5
Y = (rng.random(N) < 0.6).astype(int)
TRAIN, CLEAN = rng.random(N) < 0.5, rng.random(N) < 0.8
CTRL = rng.normal(size=(N, 2))
X = rng.normal(size=(2, N, D)) * [1, 2, 0.5, 3, 1] + Y[:, None] * [0.8, 0, 0, 0.2, 0] + CTRL[:, :1]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, layer, X[layer, i].tolist(), int(Y[i]), bool(TRAIN[i]), bool(CLEAN[i]), CTRL[i].tolist(), int(i % 3)) for layer in (0, 1) for i in range(N)]
    return spark.createDataFrame(data, "row_id long, layer int, x array<double>, y int, train boolean, clean boolean, c array<double>, kind int").repartition(3).cache()


def t_tail(t, df):
    """Two-sided tail by summing the density."""
    s = np.linspace(0, abs(t), 200_001)
    f = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + s * s / df) ** (-(df + 1) / 2)
    return 1 - 2 * float(((f[1:] + f[:-1]) / 2 * np.diff(s)).sum())


def welch(x, y):
    a, b = x[y == 1], x[y == 0]
    va, vb = a.var(ddof=1), b.var(ddof=1)
    d = (a.mean() - b.mean()) / math.sqrt(((len(a) - 1) * va + (len(b) - 1) * vb) / (len(a) + len(b) - 2))
    sa, sb = va / len(a), vb / len(b)
    df = (sa + sb) ** 2 / (sa**2 / (len(a) - 1) + sb**2 / (len(b) - 1))
    return d, t_tail((a.mean() - b.mean()) / math.sqrt(sa + sb), df)


def test_t_tail(spark):
    df = spark.createDataFrame([(t, n) for t in (0.0, 0.3, 1.0, 2.5, 6.0) for n in (1.0, 2.5, 10.0, 120.0, 5000.0)], "t double, n double")
    for r in df.select("t", "n", t_two_sided(F.col("t"), F.col("n")).alias("p"), log_gamma(F.col("n")).alias("g")).collect():
        assert r.p == pytest.approx(t_tail(r.t, r.n), abs=1e-8)
        assert r.g == pytest.approx(math.lgamma(r.n), rel=1e-12, abs=1e-10)


def test_channel_table(rows):
    got = {(r.layer, r.channel): r for r in C.channel_table(rows, (0.2, 0.8), 6.0).collect()}
    assert len(got) == 2 * D
    for layer in (0, 1):
        x = X[layer]
        rms = np.sqrt((x[TRAIN] ** 2).mean(0))
        unit = x / np.sqrt((x * x).mean(1))[:, None]
        for c in range(D):
            r = got[layer, c]
            share, ratio = ((rms <= rms[c]).sum()) / D, abs(x[TRAIN, c]).max() / np.median(rms)
            assert (r.rms, r.rms_share, r.peak_ratio) == pytest.approx((rms[c], share, ratio))
            assert r.middle == (0.2 <= share <= 0.8 and ratio < 6)
            for name, v, when in (("discovery", x, TRAIN), ("test", x, ~TRAIN), ("clean", x, ~TRAIN & CLEAN), ("unit", unit, ~TRAIN)):
                assert (r[f"{name}_d"], r[f"{name}_p"]) == pytest.approx(welch(v[when, c], Y[when]), abs=1e-7)


def test_controlled(rows):
    got = {(r.layer, r.channel): r for r in C.controlled(rows, F.col("c")).collect()}
    c = np.column_stack([np.ones(N), CTRL])
    for layer in (0, 1):
        for k in range(D):
            left = [v - c @ np.linalg.lstsq(c[TRAIN], v[TRAIN], rcond=None)[0] for v in (X[layer][:, k], Y.astype(float))]
            for name, when in (("discovery", TRAIN), ("test", ~TRAIN)):
                r, df = np.corrcoef(left[0][when], left[1][when])[0, 1], when.sum() - 2 - 3
                assert got[layer, k][f"{name}_r"] == pytest.approx(r)
                assert got[layer, k][f"{name}_p"] == pytest.approx(t_tail(r * math.sqrt(df / (1 - r * r)), df), abs=1e-7)


def test_repeats(rows, spark):
    every = spark.createDataFrame([(layer, k) for layer in (0, 1) for k in range(D)], "layer int, channel int")
    for r in C.per_category(rows, every, "kind").collect():
        when = ~TRAIN & (np.arange(N) % 3 == r.kind)
        assert (r.d, r.p) == pytest.approx(welch(X[r.layer][when, r.channel], Y[when]), abs=1e-7) and r.n == when.sum()
    for r in C.over_layers(rows, every, 0).collect():
        assert r.r == pytest.approx(np.corrcoef(X[0][~TRAIN, r.channel], X[r.layer][~TRAIN, r.channel])[0, 1])
    (one, *_), u = [r for r in C.updates(rows, every, 0).collect() if r.channel == 2], (X[1] - X[0])[~TRAIN, 2]
    y = Y[~TRAIN]
    half = 1.96 * math.sqrt(u[y == 1].var(ddof=1) / y.sum() + u[y == 0].var(ddof=1) / (1 - y).sum())
    delta = u[y == 1].mean() - u[y == 0].mean()
    assert (one.delta, one.low, one.high) == pytest.approx((delta, delta - half, delta + half))


def test_channels_without_spread(spark):
    flat = spark.createDataFrame([(i, 0, [1.0], i % 2, i < 6, True) for i in range(12)], "row_id long, layer int, x array<double>, y int, train boolean, clean boolean")
    r = C.channel_table(flat).first()
    assert (r.discovery_d, r.discovery_p, r.test_d, r.test_p) == (0, 1, 0, 1)
