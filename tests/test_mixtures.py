"""Converging fits against numpy, their likelihood, and dead components."""

import numpy as np
import pytest

from layerroutes.operators import mixtures as M

rng = np.random.default_rng(11)
CENTRES = np.array([[0.0, 0, 0], [6, 0, 1], [0, 7, -2]])
CLOUD = np.concatenate([c + rng.normal(size=(n, 3)) * s for c, n, s in zip(CENTRES, (120, 60, 90), (0.5, 1.0, 0.7))]) + 1000


@pytest.fixture(scope="module")
def states(spark):
    rows = [(i, layer, (v * (1 + layer)).tolist(), i % 2 == 0) for layer in (0, 1) for i, v in enumerate(CLOUD)]
    return spark.createDataFrame(rows, "row_id long, layer int, x array<double>, half boolean").repartition(3).cache()


def density(x, f):
    full = {"diag": lambda c: np.diag(f.cov[c]), "spherical": lambda c: np.diag(f.cov[c]), "tied": lambda c: f.cov, "full": lambda c: f.cov[c]}[f.kind]
    out = []
    for c in range(f.k):
        d = x - f.means[c]
        s = full(c)
        out.append(np.log(f.weights[c]) - 0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d) + np.log(np.linalg.det(2 * np.pi * s))))
    return np.stack(out, 1)


@pytest.mark.parametrize("kind", ["diag", "spherical", "tied", "full"])
def test_a_step_is_em(states, kind):
    d = 3
    cov = {"diag": np.full((2, d), 4.0), "spherical": np.full((2, d), 4.0), "tied": np.eye(d) * 4 + 1, "full": np.stack([np.eye(d) * 4 + 1, np.eye(d) * 9 - 0.5])}[kind]
    f = M.Fit(0, 2, kind=kind, weights=np.array([0.3, 0.7]), means=CENTRES[:2] + 1000.5, cov=cov)
    (got,) = M.step(states, [f])
    j = density(CLOUD, f)
    ll = np.log(np.exp(j).sum(1))
    r = np.exp(j - ll[:, None])
    n = r.sum(0)
    assert got.history == [pytest.approx(ll.mean())]
    assert np.allclose(got.weights, n / n.sum()) and np.allclose(got.means, (r.T @ CLOUD) / n[:, None])
    each = [np.cov(CLOUD.T, aweights=r[:, c], bias=True) for c in range(2)]
    want = {"diag": [np.diag(e) for e in each], "spherical": [np.full(d, np.trace(e) / d) for e in each], "full": each, "tied": sum(e * w for e, w in zip(each, n / n.sum()))}[kind]
    assert np.allclose(got.cov, np.array(want) + 1e-6 * (np.eye(d) if kind in ("full", "tied") else 1), atol=1e-8)


def test_fits_converge_and_never_lose_likelihood(states):
    fits = [M.Fit(layer, 3, start, kind) for layer in (0, 1) for kind in ("diag", "full") for start in range(3)]
    got = M.fit(states, fits, tolerance=1e-7)
    for f in got:
        assert f.converged and f.steps == len(f.history)
        assert all(b >= a - 1e-6 for a, b in zip(f.history, f.history[1:])) and f.score >= f.history[0]
    for (layer, kind), f in M.best(got, lambda f: (f.layer, f.kind)).items():
        assert f.score == max(g.score for g in got if (g.layer, g.kind) == (layer, kind))
        found = sorted(np.round(f.means / (1 + layer) - 1000).tolist())
        assert found == sorted(CENTRES.tolist()) and sorted(np.round(f.weights * 270)) == pytest.approx([60, 90, 120], abs=2)
    again = M.fit(states, [g for g in got if g.layer == 0], iterations=3, tolerance=1e-6)
    assert all(f.converged for f in again)


def test_a_dead_component_starts_anew(states):
    far = np.vstack([CENTRES[:2] + 1000, [[1e6, 1e6, 1e6]]])
    f = M.Fit(0, 3, weights=np.full(3, 1 / 3), means=far, cov=np.ones((3, 3)))
    (one,) = M.step(states, [f])
    assert (abs(CLOUD - one.means[2]).sum(1) < 1e-9).any() and one.weights[2] == pytest.approx(1 / 271, rel=1e-6)
    assert np.allclose(one.cov[2], CLOUD.var(0) + 1e-6)
    (end,) = M.fit(states, [f])
    assert end.weights.min() > 0.05
    (hard,) = M.fit(states, [M.Fit(0, 3, kind="kmeans", means=far)])
    assert hard.k == 3 and hard.weights.min() > 0.05


def test_kmeans_and_rows_in_use(states):
    got = M.fit(states, [M.Fit(0, 3, s, "kmeans", use) for s in range(2) for use in (None, "half")], tolerance=0)
    for f in got:
        x = CLOUD[::2] if f.use else CLOUD
        near = ((x[:, None] - f.means) ** 2).sum(2)
        assert f.converged and np.allclose(f.means, [x[near.argmin(1) == c].mean(0) for c in range(3)])
        assert f.score == pytest.approx(-near.min(1).mean())


def test_one_model_over_all_layers(states):
    (f,) = M.fit(states, [M.Fit(None, 4)], iterations=20)
    assert f.weights.sum() == pytest.approx(1.0)
    p = M.posterior(states, [f]).toPandas()
    assert len(p) == 540 and np.allclose([sum(s) for s in p["shares"]], 1)
    both = np.concatenate([CLOUD, CLOUD * 2])
    assert p["logp"].mean() == pytest.approx(np.log(np.exp(density(both, f)).sum(1)).mean())


def test_more_components_than_distinct_rows(spark):
    few = spark.createDataFrame([(i, 0, [float(i % 2)]) for i in range(10)], "row_id long, layer int, x array<double>")
    (f,) = M.fit(few, [M.Fit(0, 3, kind="kmeans")])
    assert f.score == 0


def test_minibatch(states):
    for f in M.minibatch(states, {0: 3, 1: 3}, batch=100, steps=60):
        (whole,) = M.fit(states, [M.Fit(f.layer, 3, kind="kmeans", means=f.means)])
        assert f.score >= 1.2 * whole.score and f.steps == len(f.history) and f.weights.sum() == pytest.approx(1)


def test_refits_and_their_distances(states, spark):
    from layerroutes.operators import reliability as R

    made = R.refits(states, [R.Variant("base"), R.Variant("other", 1), R.Variant("part", 0, 0.6)], [2, 3, 4])
    assert len(made) == 18
    for layer in (0, 1):
        assert R.k_curve(made, "base")[layer] == min((2, 3, 4), key=lambda k: made["base", layer, k][1])
        assert R.k_curve(made, "base", 2)[layer] == 2
    f, c = made["base", 0, 3]
    assert c == pytest.approx(-2 * np.log(np.exp(density(CLOUD, f)).sum(1)).sum() + 20 * np.log(270))
    rows = {(v, layer): dist for v, layer, _, dist in R.persistence(made, "base")}
    assert rows["other", 0] < 1e-3 and rows["part", 0] < 1e-3 < rows["random0", 0]
    pairs = spark.createDataFrame([("base", "x", 1), ("y", "base", 2), ("x", "y", 3), ("base", "base", 4)], "a string, b string, d int")
    assert {(r.other, r.d) for r in R.against(pairs, "base").collect()} == {("x", 1), ("y", 2)}


def test_lloyd_keeps_all_centres(states, spark):
    from layerroutes.operators.cluster import kmeans

    far = [(layer, s, [v] * 3) for layer in (0, 1) for s, v in ((0, 1000.0 * (1 + layer)), (1, 1e9), (2, -1e9))]
    got, _ = kmeans(states, spark.createDataFrame(far, "layer int, state int, mu array<double>"), 10)
    rows = got.collect()
    assert len(rows) == 6 and max(abs(v) for r in rows for v in r.mu) < 1e4


def test_scan_against_numpy(states, spark):
    from layerroutes.operators import scan as S

    one = states.where("layer = 0")
    got = {r.k: r for r in S.scan(one, [2, 3, 270], eval_rows=1000).collect()}
    assert (got[270].bic, got[270].silhouette, got[270].failed) == (None, None, "270 rows") and got[3].failed is None
    fits = {(f.k, f.start): f for f in M.fit(one, [M.Fit(0, k, s) for k in (2, 3) for s in range(3)], 100, 1e-5)}
    for k in (2, 3):
        f = fits[k, 0]
        j = density(CLOUD, f)
        ll = np.log(np.exp(j).sum(1))
        r = np.exp(j - ll[:, None])
        bic = -2 * ll.sum() + (2 * k * 3 + k - 1) * np.log(270)
        assert (got[k].bic, got[k].icl) == pytest.approx((bic, bic - 2 * (r * np.log(np.maximum(r, 1e-300))).sum()))
        z, dist = j.argmax(1), np.sqrt(((CLOUD[:, None] - CLOUD) ** 2).sum(2))
        sil = []
        for i in range(270):
            own = (z == z[i]) & (np.arange(270) != i)
            a, b = dist[i, own].mean(), min(dist[i, z == c].mean() for c in range(k) if c != z[i])
            sil.append((b - a) / max(a, b))
        assert got[k].silhouette == pytest.approx(np.mean(sil))
    assert got[3].stability > 0.9 and got[3].converged


def test_a_singular_fit_is_told(spark):
    flat = spark.createDataFrame([(i, 0, [float(i % 7), 1.0]) for i in range(60)], "row_id long, layer int, x array<double>")
    (f, g) = M.fit(flat, [M.Fit(0, 2, kind="full"), M.Fit(0, 2)], regular=lambda v: v)
    assert f.failed and f.score == float("-inf") and g.failed
    (h,) = M.fit(flat, [M.Fit(0, 2, kind="full")])
    assert not h.failed and np.isfinite(h.score)


def test_scan_names_states_of_sampled_rows_only(states, spark, monkeypatch):
    from layerroutes.operators import scan as S

    one, asked, posterior = states.where("layer = 0"), [], M.posterior
    monkeypatch.setattr(M, "posterior", lambda s, fits: asked.append(s.count()) or posterior(s, fits))
    S.scan(one, [2], eval_rows=20, iterations=2).collect()
    assert asked == [20]
    fits = M.fit(one, [M.Fit(0, 3, s) for s in range(3)], iterations=2)
    rows = {i: {r.row_id: r.state for r in posterior(one, [f]).collect()} for i, f in enumerate(fits)}
    want = {}
    for p, q in ((0, 1), (0, 2), (1, 2)):
        for r in rows[p]:
            at = (p, q, rows[p][r], rows[q][r])
            want[at] = want.get(at, 0) + 1
    assert {(r.p, r.q, r.a, r.b): r.n for r in S.tables(one, fits).collect()} == want


def whole_silhouette(x, z):
    dist, values = np.sqrt(((x[:, None] - x) ** 2).sum(2)), []
    for i in range(len(x)):
        own = (z == z[i]) & (np.arange(len(x)) != i)
        a, b = dist[i, own].mean() if own.any() else None, min(dist[i, z == c].mean() for c in set(z) - {z[i]})
        values.append(0.0 if a is None else (b - a) / max(a, b))
    return np.mean(values)


def test_scan_measures_the_silhouette_of_all_rows(spark):
    from layerroutes.operators import scan as S

    draw = np.random.default_rng(4)
    x = {0: draw.normal(size=(900, 3)) + draw.integers(0, 3, (900, 1)), 1: draw.normal(size=(700, 2)).astype(np.float32).astype(float) * [1, 4]}
    df = spark.createDataFrame([(i, layer, v.tolist()) for layer in x for i, v in enumerate(x[layer])], "row_id long, layer int, x array<double>")
    got = {(r.layer, r.k): r.silhouette for r in S.scan(df, [2, 3], repeats=0, iterations=20).collect()}
    fits = M.fit(df, [M.Fit(layer, k) for layer in x for k in (2, 3)], 20)
    assert len(got) == 4
    for f in fits:
        assert got[f.layer, f.k] == pytest.approx(whole_silhouette(x[f.layer], f.shares(x[f.layer])[0].argmax(1)), rel=1e-9)


def test_silhouettes_of_close_far_lone_and_equal_rows(spark, monkeypatch):
    from layerroutes.operators import scan as S

    draw = np.random.default_rng(5)  # two groups of spread 1e-6 that are 1e-5 apart, one 1e4 away, one row alone, copies
    x = np.concatenate([1e-6 * draw.normal(size=(40, 2)), 1e-6 * draw.normal(size=(40, 2)) + 1e-5, 1e4 + draw.normal(size=(40, 2)), [[-7.0, 3.0]]])
    z = np.repeat([0, 1, 2, 3], [40, 40, 40, 1])
    x[1] = x[0]
    df = spark.createDataFrame([(i, 0, v.tolist(), [int(z[i]), 0]) for i, v in enumerate(x)], "row_id long, layer int, x array<double>, named array<int>").repartition(3)
    for held, chunk in ((S.HELD, S.CHUNK), (20, 5)):
        monkeypatch.setattr(S, "HELD", held)
        monkeypatch.setattr(S, "CHUNK", chunk)
        (r,) = S.silhouettes(df, {0: [5, 1]}, {0: len(x)}, {0: 2}).collect()  # the last state has no rows; one state alone has no silhouette
        assert r.k == 5 and r.silhouette == pytest.approx(whole_silhouette(x, z), abs=1e-7)
