"""Models fitted from sums of products. One pass adds up each group's matrix of sums; small
solves per group then give bases, directions and factor models. A task of a solve holds the
square of the width, never rows of the input."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerroutes.functions import arrays as A

HELD = 64 << 20  # bytes of partial sums that a task keeps before it hands them on


def sums(rows: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """(by, i, j, v): sums of products of [1, x]; entry (0, 0) counts the rows. Shift rows
    first where means are large against spreads."""
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("i", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def frames(held):
        for key, m in held.items():
            yield pd.DataFrame({**{c: [k] * len(m) for c, k in zip(by, key)}, "i": range(len(m)), "s": list(m)})

    def partial(batches):
        held = {}
        for f in batches:
            for key, g in f.groupby(by, sort=False, dropna=False):
                m = np.column_stack([np.ones(len(g)), np.stack(g[x].to_numpy())])
                held[key] = held.get(key, 0) + m.T @ m
                if len(held) * held[key].nbytes > HELD:
                    yield from frames(held)
                    held = {}
        yield from frames(held)

    parts = rows.select(*by, x).mapInPandas(partial, schema)
    return parts.select(*by, "i", F.posexplode("s").alias("j", "v")).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def solve(products: DataFrame, by: list[str], f, fields: str) -> DataFrame:
    """The rows that ``f(n, mean, cov)`` gives for each group of ``sums``."""
    schema = T.StructType([*(products.schema[c] for c in by), *T.StructType.fromDDL(fields).fields])

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        d = int(frame["i"].max()) + 1
        g = np.zeros((d, d))
        g[frame["i"], frame["j"]] = frame["v"]
        mean = g[0, 1:] / g[0, 0]
        rows = [(*key, *r) for r in f(g[0, 0], mean, g[1:, 1:] / g[0, 0] - np.outer(mean, mean))]
        return pd.DataFrame(rows, columns=schema.names)

    return products.groupBy(*by).applyInPandas(one, schema)  # width squared a group


def _eigen(cov):
    w, v = np.linalg.eigh(cov)
    v = v[:, ::-1] * np.where(v[np.abs(v).argmax(0), range(len(w))] < 0, -1, 1)[::-1]
    return np.maximum(w[::-1], 0), v


def bases(rows: DataFrame, by: list[str], rank: int) -> DataFrame:
    """Principal components per group: (by, component, value, vector, mean, n), value with n - 1
    below the line; the entry of a vector that is largest in size is positive."""

    def f(n, mean, cov):
        w, v = _eigen(cov)
        return [(k, float(w[k] * n / max(n - 1, 1)), v[:, k], mean, int(n)) for k in range(min(rank, len(w)))]

    return solve(sums(rows, by), by, f, "component int, value double, vector array<double>, mean array<double>, n long")


def spectrum(rows: DataFrame, by: list[str]) -> DataFrame:
    """Eigenvalues of each group's covariance, shares, ranks for 90 and 95 %, entropy rank."""

    def f(n, mean, cov):
        w, _ = _eigen(cov)
        s = w / max(w.sum(), 1e-300)
        run, some = np.cumsum(s), s[s > 0]
        return [(int(n), float(w.sum()), w, run, *(int(min(np.searchsorted(run, q), len(w) - 1) + 1) for q in (0.9, 0.95)), float(np.exp(-(some * np.log(some)).sum())))]

    return solve(sums(rows, by), by, f, "n long, trace double, eigenvalues array<double>, shares array<double>, d90 int, d95 int, entropy_rank double")


def packed(b: DataFrame, by: list[str]) -> DataFrame:
    """A group's components as one array beside its mean."""
    return b.groupBy(*by).agg(F.first("mean").alias("mean"), F.sort_array(F.collect_list(F.struct("component", "value", "vector"))).alias("basis"))


def scores(x: Column, mean: Column, basis: Column, whiten: bool = False) -> Column:
    d = A.minus(x, mean)
    return F.transform(basis, lambda b: A.dot(d, b["vector"]) / (F.sqrt(b["value"] + 1e-12) if whiten else F.lit(1.0)))


def restored(z: Column, mean: Column, basis: Column, whiten: bool = False) -> Column:
    """The vector whose ``scores`` are z."""
    parts = F.zip_with(z, basis, lambda s, b: F.transform(b["vector"], lambda v: v * s * (F.sqrt(b["value"] + 1e-12) if whiten else F.lit(1.0))))
    return F.aggregate(parts, mean, lambda a, p: F.zip_with(a, p, lambda u, v: u + v))


def factors(rows: DataFrame, by: list[str], q: int, iterations: int = 100, floor: float = 1e-6) -> DataFrame:
    """A factor model of each group (a fixed partition): (by, n, mean, loadings with q numbers a
    coordinate, noise), by EM on the group's covariance, which holds all that EM needs."""

    def f(n, mean, cov):
        w, v = _eigen(cov)
        load, psi = v[:, :q] * np.sqrt(w[:q]), np.maximum(np.diag(cov) / 2, floor)
        for _ in range(iterations):
            b = np.linalg.solve(np.eye(q) + load.T @ (load / psi[:, None]), (load / psi[:, None]).T)
            inner = np.eye(q) - b @ load + b @ cov @ b.T
            load = np.linalg.solve(inner, b @ cov).T
            psi = np.maximum(np.diag(cov - load @ b @ cov), floor)
        return [(int(n), mean, load.ravel(), psi)]

    return solve(sums(rows, by), by, f, "n long, mean array<double>, loadings array<double>, noise array<double>")


def dimensions(model: DataFrame, by: list[str], q: int) -> DataFrame:
    """Participation dimensions of the factor part, the noise and the whole covariance."""
    ds = T.StructType([*(model.schema[c] for c in by), *T.StructType.fromDDL("factor_pr double, noise_pr double, model_pr double, factor_share double, d90 int, entropy_rank double").fields])

    def part(batches):
        for f in batches:
            out = []
            for r in f.itertuples():
                w, psi = np.reshape(r.loadings, (-1, q)), np.asarray(r.noise)
                gram, t, u = w.T @ w, (w * w).sum(), psi.sum()
                sq, cross = (gram * gram).sum(), psi @ (w * w).sum(1)
                e = np.maximum(np.linalg.eigvalsh(gram)[::-1], 0) / max(t, 1e-300)
                some = e[e > 0]
                out.append((*(getattr(r, c) for c in by), t * t / max(sq, 1e-300), u * u / (psi @ psi), (t + u) ** 2 / (sq + 2 * cross + psi @ psi), t / (t + u), int(min(np.searchsorted(np.cumsum(e), 0.9), q - 1) + 1), float(np.exp(-(some * np.log(some)).sum()))))
            yield pd.DataFrame(out, columns=ds.names)

    return model.mapInPandas(part, ds)


def _load(model: DataFrame, q: int) -> dict:
    """K components a layer, on the driver: the caller's bound is layers x K x width x q."""
    out: dict = {}
    for r in model.orderBy("layer", "state").collect():
        out.setdefault(r.layer, []).append((r.state, float(r.n), np.array(r.mean), np.reshape(r.loadings, (-1, q)), np.array(r.noise)))
    return out


def _joint(x, parts, q):
    """Log joint of rows and components by the matrix inversion lemma, with each component's
    posterior means of the factors."""
    total, lj, zs = sum(p[1] for p in parts), [], []
    for _, n, mu, w, psi in parts:
        d = x - mu
        m = np.eye(q) + w.T @ (w / psi[:, None])
        low = (d / psi) @ w
        z = np.linalg.solve(m, low.T).T
        mahal = (d * d / psi).sum(1) - (low * z).sum(1)
        lj.append(np.log(n / total) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.log(psi).sum() + np.linalg.slogdet(m)[1] + mahal))
        zs.append(z)
    return np.stack(lj, 1), zs


def factor_rows(rows: DataFrame, model: DataFrame, q: int) -> DataFrame:
    """Rows under a factor mixture: likeliest state, log density, distances to it split in the
    latent and the residual part and along and across the loadings, and the relative error of
    its posterior-mean reconstruction (hard) and of that weighted by posteriors (soft)."""
    parts = _load(model, q)

    def score(batches):
        for f in batches:
            for layer, g in f.groupby("layer"):
                x, ps = np.stack(g["x"].to_numpy()), parts[int(layer)]
                lj, zs = _joint(x, ps, q)
                top = lj.max(1, keepdims=True)
                logp = top[:, 0] + np.log(np.exp(lj - top).sum(1))
                best, resp = lj.argmax(1), np.exp(lj - logp[:, None])
                back = np.stack([p[2] + z @ p[3].T for p, z in zip(ps, zs)], 1)
                out = pd.DataFrame({"row_id": g["row_id"], "layer": g["layer"], "state": np.array([p[0] for p in ps])[best], "logp": logp})
                for k, (_, _, mu, w, psi) in enumerate(ps):
                    at = best == k
                    d, z = x[at] - mu, zs[k][at]
                    u = np.linalg.svd(w, full_matrices=False)[0]
                    along = ((d @ u) ** 2).sum(1)
                    for name, v in (("latent", (z * z).sum(1)), ("residual", ((d - z @ w.T) ** 2 / psi).sum(1)), ("parallel", along), ("across", np.maximum((d * d).sum(1) - along, 0))):
                        out.loc[at, name] = np.sqrt(v)
                size = np.maximum(np.linalg.norm(x, axis=1), 1e-30)
                out["hard_error"] = np.linalg.norm(x - back[np.arange(len(x)), best], axis=1) / size
                out["soft_error"] = np.linalg.norm(x - (resp[:, :, None] * back).sum(1), axis=1) / size
                yield out

    return rows.select("row_id", "layer", "x").mapInPandas(score, "row_id long, layer int, state int, logp double, latent double, residual double, parallel double, across double, hard_error double, soft_error double")


def factor_mixture(rows: DataFrame, model: DataFrame, q: int, iterations: int = 5, floor: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """EM of a mixture of factor analysers from a model, for all layers: each iteration is one
    pass of partial sums; the driver solves K small systems a layer. A component that loses
    its rows is an error. Also gives the log-likelihood before each step."""
    spark, history = rows.sparkSession, []

    def estep(parts):
        def run(batches):
            held = {}
            for f in batches:
                for layer, g in f.groupby("layer"):
                    x, ps = np.stack(g["x"].to_numpy()), parts[int(layer)]
                    lj, zs = _joint(x, ps, q)
                    top = lj.max(1, keepdims=True)
                    logp = top[:, 0] + np.log(np.exp(lj - top).sum(1))
                    for k, p in enumerate(ps):
                        r = np.exp(lj[:, k] - logp)
                        za = np.column_stack([zs[k], np.ones(len(x))])
                        m = np.linalg.inv(np.eye(q) + p[3].T @ (p[3] / p[4][:, None]))
                        second = (za * r[:, None]).T @ za
                        second[:q, :q] += r.sum() * m
                        key, v = (int(layer), p[0]), np.concatenate([[r.sum(), logp.sum() if k == 0 else 0.0], second.ravel(), (x.T @ (za * r[:, None])).ravel(), r @ (x * x)])
                        held[key] = held.get(key, 0) + v
            if held:
                yield pd.DataFrame([(a, b, v) for (a, b), v in held.items()], columns=["layer", "state", "v"])

        return run

    for _ in range(iterations):
        parts = _load(model, q)
        e = rows.select("layer", "x").mapInPandas(estep(parts), "layer int, state int, v array<double>")
        s = e.select("layer", "state", F.posexplode("v").alias("i", "v")).groupBy("layer", "state", "i").agg(F.sum("v").alias("v"))
        got = s.groupBy("layer", "state").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda t: t["v"]).alias("v")).collect()  # K a layer
        new = []
        for r in got:
            v = np.array(r.v)
            if v[0] < 1e-8:
                raise ValueError(f"component {r.state} of layer {r.layer} has no rows left")
            second, rest = v[2 : 2 + (q + 1) ** 2].reshape(q + 1, q + 1), v[2 + (q + 1) ** 2 :]
            d = len(rest) // (q + 2)
            cross = rest[: d * (q + 1)].reshape(d, q + 1)
            wm = np.linalg.solve(second, cross.T).T
            psi = np.maximum((rest[d * (q + 1) :] - (wm * cross).sum(1)) / v[0], floor)
            new.append((r.layer, r.state, float(v[0]), wm[:, q].tolist(), wm[:, :q].ravel().tolist(), psi.tolist()))
        history.append(float(sum(r.v[1] for r in got)))
        model = spark.createDataFrame(new, "layer int, state int, n double, mean array<double>, loadings array<double>, noise array<double>")
    return model, history


def ridge(rows: DataFrame, by: list[str], width: int, alpha: float) -> DataFrame:
    """Ridge weights of standardised coordinates for the targets that follow the first
    ``width`` entries of x: (by, target, w in the given scale, intercept)."""

    def f(n, mean, cov):
        sd = np.maximum(np.sqrt(np.maximum(np.diag(cov)[:width], 0)), 1e-8)
        z = cov[:width, :width] / np.outer(sd, sd)
        for t in range(width, len(mean)):
            w = np.linalg.solve(n * z + alpha * np.eye(width), n * cov[:width, t] / sd) / sd
            yield t - width, w, float(mean[t] - w @ mean[:width])

    return solve(sums(rows, by), by, f, "target int, w array<double>, intercept double")


def least_squares(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """Least-squares weights of the first ``width`` entries of x (and an intercept) for each
    entry after them: (by, target, w, intercept); directions without spread get none."""

    def f(n, mean, cov):
        inv = np.linalg.pinv(cov[:width, :width], rcond=1e-10, hermitian=True)
        for t in range(width, len(mean)):
            w = inv @ cov[:width, t]
            yield t - width, w, float(mean[t] - w @ mean[:width])

    return solve(sums(rows, by), by, f, "target int, w array<double>, intercept double")


def discriminant(rows: DataFrame, by: list[str]) -> DataFrame:
    """Linear discriminant of label 1 over 0 with the pooled covariance: (by, w, intercept).
    The label goes in as one more coordinate, so that one matrix of sums tells both classes."""
    joined = rows.withColumn("x", F.concat("x", F.array(F.col("label").cast("double"))))

    def f(n, mean, cov):
        p = mean[-1]
        gap = cov[:-1, -1] / (p * (1 - p))  # difference of the class means
        pooled = cov[:-1, :-1] - p * (1 - p) * np.outer(gap, gap)
        w = np.linalg.pinv(pooled, hermitian=True) @ gap
        middle = mean[:-1] + (0.5 - p) * gap
        return [(w, float(np.log(p / (1 - p)) - w @ middle))]

    return solve(sums(joined, by), by, f, "w array<double>, intercept double")
