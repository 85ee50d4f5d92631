"""Fitted models against direct computations on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerroutes.functions.stats import mann_whitney, normal_tail
from layerroutes.operators import align, cluster, fits, latent
from layerroutes.operators.transforms import Chain

SCHEMA = "row_id long, layer int, x array<double>"


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5)) + 0.2 * rng.normal(size=(200, 5)) + 1.0


@pytest.fixture(scope="module")
def rows(spark, cloud):
    return spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(cloud)], SCHEMA).repartition(3)


def test_spectrum_and_bases(rows, cloud):
    w = np.linalg.eigvalsh(np.cov(cloud.T, bias=True))[::-1]
    r = fits.spectrum(rows, ["layer"]).first()
    assert np.allclose(r.eigenvalues, w, atol=1e-9) and r.n == 200
    assert r.d90 == np.searchsorted(np.cumsum(w) / w.sum(), 0.9) + 1
    for b in fits.bases(rows, ["layer"], 2).collect():
        v = np.array(b.vector)
        assert np.isclose(b.value, w[b.component] * 200 / 199) and v[np.abs(v).argmax()] > 0
        assert np.allclose(np.cov(cloud.T, bias=True) @ v, w[b.component] * v, atol=1e-9)


def test_chain_goes_back(rows, cloud):
    c = Chain([{"step": "standardise"}, {"step": "pca", "rank": 5, "whiten": True}], must_invert=True).fit(rows)
    back = {r.row_id: r.x for r in c.inverse(c.transform(rows)).collect()}
    assert all(np.allclose(back[i], v, atol=1e-6) for i, v in enumerate(cloud))
    with pytest.raises(ValueError):
        Chain([{"step": "l2"}], must_invert=True)


def test_factor_model(spark, rows, cloud):
    q = 2
    m = fits.factors(rows.withColumn("state", F.lit(0)), ["layer", "state"], q)
    r = m.first()
    w, psi = np.reshape(r.loadings, (-1, q)), np.array(r.noise)
    cov = w @ w.T + np.diag(psi)
    assert np.abs(cov - np.cov(cloud.T, bias=True)).max() < 0.1
    d = cloud - np.array(r.mean)
    want = -0.5 * (5 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + (d * np.linalg.solve(cov, d.T).T).sum(1))
    for s in fits.factor_rows(rows, m, q).collect():
        assert np.isclose(s.logp, want[s.row_id])
        assert np.isclose(s.latent**2 + s.residual**2, d[s.row_id] @ np.linalg.solve(cov, d[s.row_id]))
        assert np.isclose(s.parallel**2 + s.across**2, d[s.row_id] @ d[s.row_id])
    two = spark.createDataFrame([(0, k, 100.0, (np.array(r.mean) + k).tolist(), list(r.loadings), list(r.noise)) for k in (0, 1)], "layer int, state int, n double, mean array<double>, loadings array<double>, noise array<double>")
    _, history = fits.factor_mixture(rows, two, q, iterations=4)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))


def test_linear_models(spark, cloud):
    rng = np.random.default_rng(5)
    y = (cloud[:, 0] + rng.normal(size=200) > 1).astype(int)
    df = spark.createDataFrame([(i, 0, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(cloud, y))], SCHEMA + ", label int")
    a, b = cloud[y == 1], cloud[y == 0]
    pooled = (np.cov(a.T, bias=True) * len(a) + np.cov(b.T, bias=True) * len(b)) / 200
    w = np.linalg.solve(pooled, a.mean(0) - b.mean(0))
    r = fits.discriminant(df, ["layer"]).first()
    assert np.allclose(r.w, w, rtol=1e-6)
    assert np.isclose(r.intercept, np.log(len(a) / len(b)) - w @ (a.mean(0) + b.mean(0)) / 2)
    z = (cloud - cloud.mean(0)) / cloud.std(0)
    coef = np.linalg.solve(z.T @ z + 10 * np.eye(5), z.T @ (y - y.mean())) / cloud.std(0)
    joined = df.withColumn("x", F.concat("x", F.array(F.col("label").cast("double"))))
    assert np.allclose(fits.ridge(joined, ["layer"], 5, 10.0).first().w, coef)
    ols = np.linalg.lstsq(np.column_stack([np.ones(200), cloud]), y, rcond=None)[0]
    r = fits.least_squares(joined, ["layer"], 5).first()
    assert np.allclose(r.w, ols[1:]) and np.isclose(r.intercept, ols[0])


def test_rank_test(spark):
    z = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.96, 4.9, 6.0, 10.0)], "z double")
    got = [r.t for r in z.select(normal_tail(F.col("z")).alias("t")).collect()]
    assert np.allclose(got, [0.5, 0.158655253931457, 0.0249978951482204, 4.79183276590319e-07, 9.86587645037698e-10, 7.61985302416053e-24], rtol=1e-8)
    df = spark.createDataFrame([("a", float(v), int(v > 5)) for v in range(1, 11)], "g string, v double, y int")
    assert mann_whitney(df, "v", "y", ["g"]).first().u == 25


def test_first_centres_differ(spark, rows):
    c = cluster.plus_plus(rows, {0: 4}, seed=1).collect()
    assert len({tuple(r.mu) for r in c}) == 4


def test_latent_models(spark):
    rng = np.random.default_rng(1)
    data = [(i, [int(v) for v in (rng.random(4) < (0.9 if i % 2 else 0.1))]) for i in range(120)]
    df = spark.createDataFrame(data, "row_id long, z array<int>")
    for fit, score in ((latent.mixture, latent.mixture_losses), (latent.hidden, latent.hidden_losses)):
        p, history = fit(df, [2] * 4, m=2, iterations=5)
        assert history[-1] > history[0]
        flat = [sum(r.losses) for r in score(df, p).collect()]
        assert sum(np.exp(-sum(r.losses)) for r in score(spark.createDataFrame([(i, [(i >> b) & 1 for b in range(4)]) for i in range(16)], df.schema), p).collect()) == pytest.approx(1.0)
        assert len(flat) == 120
        # the parameters of the last step explain the rows no worse than those before it
        assert -sum(flat) / 120 >= history[-1] - 1e-3


def brute_hidden(z, p):
    """Chance of a route by summing over all paths of classes."""
    m, depth = len(p["w"]), len(z)
    total = 0.0
    for path in itertools.product(range(m), repeat=depth):
        v = p["w"][path[0]] + sum(p["e"][l][j][z[l]] for l, j in enumerate(path))
        total += np.exp(v + sum(p["t"][l][path[l]][path[l + 1]] for l in range(depth - 1)))
    return total


def test_hidden_chain_against_all_paths(spark):
    rng = np.random.default_rng(7)
    data = [(i, [int(v) for v in rng.integers(0, [3, 2, 4])]) for i in range(60)]
    df = spark.createDataFrame(data, "row_id long, z array<int>")
    p, history = latent.hidden(df, [3, 2, 4], m=2, iterations=1)
    got = {r.row_id: r.losses for r in latent.hidden_losses(df, p).collect()}
    for i, z in data:
        assert np.exp(-sum(got[i])) == pytest.approx(brute_hidden(z, p))
        assert np.exp(-got[i][0]) == pytest.approx(sum(np.exp(p["w"][j] + p["e"][0][j][z[0]]) for j in range(2)))
    # one more step is the expectation over all paths
    q, after = latent.hidden(df, [3, 2, 4], m=2, iterations=2)
    assert after[1] == pytest.approx(np.mean([np.log(brute_hidden(z, p)) for _, z in data]))
    c = np.full((2, 2), 0.1)
    for _, z in data:
        for path in itertools.product(range(2), repeat=3):
            v = p["w"][path[0]] + sum(p["e"][l][j][z[l]] for l, j in enumerate(path)) + p["t"][0][path[0]][path[1]] + p["t"][1][path[1]][path[2]]
            c[path[0], path[1]] += np.exp(v) / brute_hidden(z, p)
    assert np.allclose(np.exp(q["t"][0]), c / c.sum(1, keepdims=True))


def test_pool_and_anchor(spark):
    c = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 0, [0.0, 2.0]), (1, 1, [-0.5, -1.0]), (2, 0, [-1.5, -3.1])], "layer int, state int, mu array<double>")
    got = {(r.layer, r.local_state): r.state for r in align.to_pool(c, threshold=0.5).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2, (2, 0): 2}
    anchored = {(r.layer, r.local_state): r.state for r in align.to_pool(c, threshold=0.5, anchor=0).collect()}
    assert anchored[2, 0] != anchored[1, 1]


def test_discover(spark, tmp_path):
    from layerroutes.sources.tables import discover

    for name, done in (("b", True), ("a", True), ("c", False), ("failed", True), ("incoming", True)):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "part-0").write_text("x")
        if done:
            (tmp_path / name / "_SUCCESS").write_text("")
    assert [p.rsplit("/", 1)[1] for p in discover(spark, f"{tmp_path}/*")] == ["a", "b"]
    assert [p.rsplit("/", 1)[1] for p in discover(spark, f"{tmp_path}/*", most=1)] == ["a"]


def test_em_step_and_criteria_do_not_shuffle_rows(spark):
    import contextlib
    import io

    rows = [(i, 0, [float(i % 3), float(i % 5)]) for i in range(60)]
    states = spark.createDataFrame(rows, "row_id long, layer int, x array<double>")
    model = spark.createDataFrame([(0, 0, 0.4, [0.5, 1.0], [1.0, 2.0]), (0, 1, 0.6, [1.5, 3.0], [0.5, 1.0])], "layer int, state int, weight double, mu array<double>, var array<double>")
    for out in (cluster.em_step(states, model), cluster.information(states, model)):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            out.explain()
        assert "hashpartitioning(row_id" not in text.getvalue()
    x = np.array([r[2] for r in rows])
    w, mu, var = np.array([0.4, 0.6]), np.array([[0.5, 1.0], [1.5, 3.0]]), np.array([[1.0, 2.0], [0.5, 1.0]])
    joint = np.log(w) - 0.5 * ((x[:, None] - mu) ** 2 / var + np.log(2 * np.pi * var)).sum(2)
    total = np.logaddexp.reduce(joint, axis=1)
    share = np.exp(joint - total[:, None])
    made = cluster.em_step(states, model).orderBy("state").collect()
    assert np.allclose([r.mu for r in made], share.T @ x / share.sum(0)[:, None]) and np.allclose([r.weight for r in made], share.mean(0))
    got = cluster.information(states, model).first()
    bic = -2 * total.sum() + 9 * np.log(60)
    assert np.allclose([got.bic, got.icl], [bic, bic - 2 * (share * np.log(share)).sum()])


def test_feature_rows_are_stored_before_a_fit_reads_them(spark, tmp_path):
    import contextlib
    import io

    from layerroutes.plans import fitted

    rows = [(i, [float((i * (j + 3)) % 11) for j in range(64)], i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, text = fitted._features(fitted.labelled(spark, str(tmp_path))), io.StringIO()
    with contextlib.redirect_stdout(text):
        x.explain()
    assert "Join" not in text.getvalue() and x.count() == 40
