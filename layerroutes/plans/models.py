"""Queries of mixtures and k-means: steps that SQL can follow, and fits to convergence."""

import numpy as np
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.operators import conditional, reliability, scan
from layerroutes.operators import mixtures as M
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql
from layerroutes.plans.registry import query

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
RHO = 0.5  # shared covariance of the fixed full model

FULL = """m AS (SELECT layer, state, mu, 0.01 + 0.001 * {own} AS v, 1.0 / count(*) OVER (PARTITION BY layer) AS w FROM centers),
 d AS (SELECT s.row_id, s.layer, c.state, s.x, w, v, list_transform(list_zip(s.x, c.mu), lambda q: q[1] - q[2]) AS d FROM states s JOIN m c ON s.layer = c.layer),
 j AS (SELECT row_id, layer, state, x, ln(w) - 0.5 * ((list_sum(list_transform(d, lambda e: e * e)) - 0.1 * pow(list_sum(d), 2)) / v + 8 * ln(2 * pi() * v) + ln(5)) AS lj FROM d),
 t AS (SELECT row_id, layer, max(lj) + ln(sum(exp(lj - mx))) AS logp FROM (SELECT *, max(lj) OVER (PARTITION BY row_id, layer) AS mx FROM j) GROUP BY ALL),
 resp AS MATERIALIZED (SELECT j.*, logp, exp(lj - logp) AS r FROM j JOIN t USING (row_id, layer))"""
MOMENTS = """, n AS (SELECT layer, state, sum(r) AS nk FROM resp GROUP BY ALL), mu AS (SELECT layer, state, i, sum(r * x[i]) / sum(r) AS m FROM resp, range(1, 9) t(i) GROUP BY ALL),
 c AS (SELECT layer, state, i, j, sum(r * x[i] * x[j]) / sum(r) AS q FROM resp, range(1, 9) t(i), range(1, 9) u(j) GROUP BY ALL),
 cov AS (SELECT c.layer, c.state, c.i, c.j, nk, a.m, q - a.m * b.m + CASE WHEN c.i = c.j THEN 1e-6 ELSE 0 END AS s FROM c JOIN n USING (layer, state) JOIN mu a ON a.layer = c.layer AND a.state = c.state AND a.i = c.i JOIN mu b ON b.layer = c.layer AND b.state = c.state AND b.i = c.j)"""


def fixed(spark, d, kind="full"):
    """Fits about the frozen centres: covariances v (I + 0.5 J), v the component's own or 0.01."""
    by: dict = {}
    for c in fx.centers(spark, d).orderBy("layer", "state").collect():  # K a layer
        by.setdefault(c.layer, []).append(c)
    shape = np.eye(fx.WIDTH) + RHO
    out = []
    for layer, cs in by.items():
        cov = 0.01 * shape if kind == "tied" else np.stack([(0.01 + 0.001 * c.state) * shape for c in cs])
        out.append(M.Fit(layer, len(cs), kind=kind, weights=np.full(len(cs), 1 / len(cs)), means=np.array([c.mu for c in cs]), cov=cov))
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query(sql(FULL.format(own="state") + " SELECT row_id, layer, state, round(r, 6) AS resp, round(logp, 6) AS logp FROM resp", "states", "centers"))
def d03_full_posterior(spark, d):
    """Responsibilities and log density under full covariances."""
    p = M.posterior(fx.states(spark, d), fixed(spark, d))
    return p.select("row_id", "layer", r6("logp"), F.posexplode("shares").alias("state", "resp")).select("row_id", "layer", "state", r6("resp"), "logp")


@query(sql(FULL.format(own="state") + MOMENTS + " SELECT layer, state, i, j, round(nk, 5) AS nk, round(m, 6) AS mu, round(s, 6) AS cov FROM cov", "states", "centers"))
def c04_full_step(spark, d):
    """A step with full covariances."""
    n = fx.states(spark, d).groupBy("layer").count().collect()  # a row a layer
    n = {r.layer: r["count"] for r in n}
    fits = M.step(fx.states(spark, d), fixed(spark, d))
    rows = [(f.layer, c, i + 1, j + 1, float(f.weights[c] * n[f.layer]), float(f.means[c, i]), float(f.cov[c, i, j])) for f in fits for c in range(f.k) for i in range(fx.WIDTH) for j in range(fx.WIDTH)]
    return frame(spark, rows, "layer int, state int, i long, j long, nk double, mu double, cov double").select("layer", "state", "i", "j", F.round("nk", 5).alias("nk"), r6("mu"), r6("cov"))


@query(sql(FULL.format(own="0") + MOMENTS + " SELECT layer, i, j, round(sum(nk * (s - CASE WHEN i = j THEN 1e-6 ELSE 0 END)) / sum(nk) + CASE WHEN i = j THEN 1e-6 ELSE 0 END, 6) AS cov FROM cov GROUP BY layer, i, j", "states", "centers"))
def c04_tied_step(spark, d):
    """A step with one full covariance a layer."""
    fits = M.step(fx.states(spark, d), fixed(spark, d, "tied"))
    rows = [(f.layer, i + 1, j + 1, float(f.cov[i, j])) for f in fits for i in range(fx.WIDTH) for j in range(fx.WIDTH)]
    return frame(spark, rows, "layer int, i long, j long, cov double").select("layer", "i", "j", r6("cov"))


def _report(spark, fits):
    rows = [(-1 if f.layer is None else f.layer, f.kind, f.k, f.start, f.steps, f.converged, float(f.score), float(f.weights.min())) for f in fits]
    s = frame(spark, rows, "layer int, kind string, k int, start int, steps int, converged boolean, score double, least_weight double")
    return s.select("layer", "kind", "k", "start", "steps", "converged", F.round("score", 4).alias("score"), F.round("least_weight", 4).alias("least_weight"))


@query()
def c02_mixture(spark, d):
    """Mixtures of four components a layer, the best of three starts, at most 60 steps here."""
    return _report(spark, M.best(M.fit(fx.states(spark, d), [M.Fit(layer, 4, s) for layer in range(fx.LAYERS) for s in range(3)], 60, 1e-4, M.adaptive())).values())


@query()
def c04_full_mixture(spark, d):
    """The same with full and tied covariances."""
    fits = M.fit(fx.states(spark, d), [M.Fit(layer, 3, s, kind) for layer in range(fx.LAYERS) for kind in ("full", "tied") for s in range(2)], 30, 1e-3, M.additive(1e-4))
    return _report(spark, M.best(fits, lambda f: (f.layer, f.kind)).values())


@query()
def c01_kmeans(spark, d):
    """k-means to convergence, the best of three starts: inertia is minus score times rows."""
    return _report(spark, M.best(M.fit(fx.states(spark, d), [M.Fit(layer, 5, s, "kmeans") for layer in range(fx.LAYERS) for s in range(3)], 60, 1e-6)).values())


@query()
def c01_minibatch(spark, d):
    return _report(spark, M.minibatch(fx.states(spark, d), {layer: 5 for layer in range(fx.LAYERS)}, batch=200, steps=40))


_GLOBAL = """m AS (SELECT state, mu FROM centers WHERE layer = 0),
 d AS (SELECT row_id, s.layer, state, x, list_sum(list_transform(list_zip(x, mu), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS q FROM states s, m),
 r AS MATERIALIZED (SELECT *, exp(-(q - min(q) OVER w) / 0.04) / sum(exp(-q / 0.04)) OVER w * exp(-(min(q) OVER w) / 0.04) AS r, row_number() OVER (PARTITION BY row_id, layer ORDER BY q, state) AS place FROM d WINDOW w AS (PARTITION BY row_id, layer)),
 p AS (SELECT state, layer, count(*) AS n FROM r WHERE place = 1 GROUP BY ALL)
SELECT state, round(max(nk), 5) AS nk, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS layer_purity FROM p JOIN (SELECT state, sum(r) AS nk FROM r GROUP BY state) USING (state) GROUP BY state"""


def _purity(rows):
    g = rows.groupBy("state", "layer").agg(F.count("*").alias("n"))
    return g.groupBy("state").agg(F.sum("n").alias("n"), r6(F.max("n") / F.sum("n"), "layer_purity"))


@query(sql(_GLOBAL, "states", "centers"))
def c08_global_step(spark, d):
    """One model over the stacked layers, about the first layer's centres: its weights after a
    step, and the largest share of one layer among the rows of a state."""
    s = fx.states(spark, d)
    mu = np.array([c.mu for c in fx.centers(spark, d).where("layer = 0").orderBy("state").collect()])  # K rows
    f = M.Fit(None, len(mu), weights=np.full(len(mu), 1 / len(mu)), means=mu, cov=np.full(mu.shape, 0.02))
    (after,) = M.step(s, [f])
    n = s.count()
    weights = frame(spark, [(c, float(w * n)) for c, w in enumerate(after.weights)], "state int, nk double")
    return _purity(M.posterior(s, [f])).join(weights, "state").select("state", F.round("nk", 5).alias("nk"), "n", "layer_purity")


@query()
def c08_global_control(spark, d):
    """A mixture fitted to all layers stacked, and the layer purity of its states."""
    s = fx.states(spark, d)
    f = M.best(M.fit(s, [M.Fit(None, 6, start) for start in range(2)], tolerance=1e-4))[None]
    return _purity(M.posterior(s, [f]))


def _refits(spark, d):
    v = [reliability.Variant("base"), reliability.Variant("seed1", 1), reliability.Variant("seed2", 2), reliability.Variant("half", 0, 0.5), reliability.Variant("most", 0, 0.8)]
    return reliability.refits(fx.states(spark, d), v, [2, 3, 4, 5])


@query()
def a12_persistence(spark, d):
    """Centres of refits with other seeds and samples, and of random ones, against the baseline's."""
    rows = reliability.persistence(_refits(spark, d), "base")
    return frame(spark, rows, "variant string, layer int, k int, distance double").select("variant", "layer", "k", F.round("distance", 4).alias("distance"))


@query()
def a12_k_curves(spark, d):
    """The K that each refit chooses layer by layer, and the baseline with a smaller largest K."""
    made = _refits(spark, d)
    curves = {n: reliability.k_curve(made, n) for n in ("base", "seed1", "seed2", "half", "most")} | {f"base up to {m}": reliability.k_curve(made, "base", m) for m in (3, 4)}
    base = curves["base"]
    rows = [(n, layer, k, k - base[layer]) for n, c in curves.items() for layer, k in sorted(c.items())]
    return frame(spark, rows, "variant string, layer int, k int, apart int")


def _conditions(spark, d):
    """The last layer's rows: category, level, state and whether cut; logs of length, vector
    size and distance from the centre."""
    rt = fx.rt(spark, d).where(F.col("layer") == fx.LAYERS - 1)
    x = fx.states(spark, d).where(F.col("layer") == fx.LAYERS - 1).select("row_id", F.log1p(A.norm(F.col("x"))).alias("norm"))
    return rt.join(x, "row_id").select("row_id", "label", "level", "state", "finish_reason", F.log1p("n_tokens").alias("length"), "norm", F.log1p(F.sqrt("dist")).alias("euclidean"))


_KINDS = ["level", "state", "finish_reason"]


def _rounded(t):
    return t.select("config", "n", *(F.round(c, 4).alias(c) for c in ("auroc", "log_loss", "auroc_gain", "loss_gain")))


@query()
def l19_conditional(spark, d):
    """What the distance tells of the label beyond composition, length and size: splines."""
    configs = {"composition": ["length"], "composition_norm": ["length", "norm"], "plus_euclidean": ["length", "norm", "euclidean"]}
    return _rounded(conditional.compared(conditional.cross_fitted(_conditions(spark, d), "row_id", "label", _KINDS, configs), "label", "composition_norm"))


@query()
def l19_boosted(spark, d):
    """The same question put to boosted trees, in three folds."""
    configs = {"composition_norm": ["length", "norm"], "plus_euclidean": ["length", "norm", "euclidean"]}
    return _rounded(conditional.compared(conditional.cross_fitted(_conditions(spark, d), "row_id", "label", _KINDS, configs, 3, "trees"), "label", "composition_norm"))


@query()
def m04_scan_grid(spark, d):
    """Criteria, silhouette and stability of converged mixtures, a row a layer and K."""
    t = scan.scan(fx.states(spark, d), [2, 3, 4, 1_000_000_000], iterations=40, tolerance=1e-4)
    return t.select("layer", "k", "n_samples", F.round("bic", 2).alias("bic"), F.round("icl", 2).alias("icl"), F.round("silhouette", 4).alias("silhouette"), F.round("stability", 4).alias("stability"), "converged", "failed")
