"""Fits of mixtures and of k-means to convergence, for all layers and restarts at once.

A step is one job: each task scores its rows under every fit that still moves and adds up the
fits' sufficient statistics, Spark sums these, and the driver, which holds parameters only (K
centres a fit, K matrices where covariances are full), sets the next parameters. Moments are
taken about the present centres, so large means cost no digits."""

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerroutes.functions.hashing import uniform

KINDS = ("diag", "spherical", "tied", "full", "kmeans")
DEAD = 1e-8
SLICE = 1 << 21  # numbers worked on at once


@dataclasses.dataclass
class Fit:
    """One fit: the rows of ``layer`` (of all layers if None), of those where column ``use`` is
    true if one is named. ``cov`` is (k, d) for diag and spherical, (k, d, d) for full, (d, d)
    for tied, None for kmeans. ``score`` is the mean log-likelihood, or minus the mean squared
    distance; ``history`` has it by step, under the parameters before the step. ``failed`` says
    why a fit could not go on; it keeps its last parameters and a score of minus infinity."""

    layer: int | None
    k: int
    start: int = 0
    kind: str = "diag"
    use: str | None = None
    weights: np.ndarray | None = None
    means: np.ndarray | None = None
    cov: np.ndarray | None = None
    score: float = float("-inf")
    steps: int = 0
    converged: bool = False
    failed: str | None = None
    history: list = dataclasses.field(default_factory=list)

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Log weight plus log density of each row and component; kmeans: minus the squared distance."""
        out = np.empty((len(x), self.k))
        for c in range(self.k):
            d = x - self.means[c]
            if self.kind == "kmeans":
                out[:, c] = -(d * d).sum(1)
                continue
            if self.kind in ("full", "tied"):
                root = np.linalg.cholesky(self.cov if self.kind == "tied" else self.cov[c])
                y, logdet = np.linalg.solve(root, d.T).T, 2 * np.log(np.diag(root)).sum()
            else:
                y, logdet = d / np.sqrt(self.cov[c]), np.log(self.cov[c]).sum()
            out[:, c] = np.log(max(self.weights[c], 1e-300)) - 0.5 * ((y * y).sum(1) + logdet + x.shape[1] * np.log(2 * np.pi))
        return out

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities and log density of each row (the first of equally near centres)."""
        j = self.joint(x)
        top = j.max(1, keepdims=True)
        if self.kind == "kmeans":
            return np.eye(self.k)[j.argmax(1)], top[:, 0]
        e = np.exp(j - top)
        total = e.sum(1, keepdims=True)
        return e / total, (top + np.log(total))[:, 0]

    def moments(self, x: np.ndarray) -> np.ndarray:
        """A row a component of [n, sums, squares or products] about its centre; last the total."""
        r, ll = self.shares(x)
        rows = []
        for c in range(self.k):
            d = x - self.means[c]
            second = (d.T * r[:, c]) @ d if self.kind in ("full", "tied") else r[:, c] @ (d * d)
            rows.append(np.concatenate([[r[:, c].sum()], r[:, c] @ d, second.ravel()]))
        last = np.zeros(len(rows[0]))
        last[:2] = len(x), ll.sum()
        return np.stack([*rows, last])

    def moved(self, m: np.ndarray, fresh: dict[int, np.ndarray], spread: np.ndarray, regular) -> "Fit":
        """The fit after a step with summed ``moments``; ``fresh`` rows stand in for dead
        components, as one row each that varies like the whole (``spread``)."""
        d = self.means.shape[1]
        n, s = m[:-1, 0].copy(), m[:-1, 1 : d + 1]
        safe = np.maximum(n, DEAD)[:, None]
        mean = self.means + s / safe
        wide = self.kind in ("full", "tied")
        second = m[:-1, d + 1 :].reshape((self.k, d, d) if wide else (self.k, d))
        shift = s / safe
        cov = second / (safe[:, :, None] if wide else safe) - (shift[:, :, None] * shift[:, None, :] if wide else shift * shift)
        for c, row in fresh.items():
            n[c], mean[c] = 1.0, row
            cov[c] = np.diag(spread) if wide else spread
        weights = n / n.sum()
        if self.kind == "tied":
            cov = np.einsum("k,kij->ij", weights, cov)
        elif self.kind == "spherical":
            cov = np.repeat(cov.mean(1, keepdims=True), d, 1)
        if self.kind == "kmeans":
            return dataclasses.replace(self, means=mean, weights=weights)
        if wide:
            at = np.arange(d)
            cov[..., at, at] = regular(np.maximum(cov[..., at, at], 0))
        else:
            cov = regular(np.maximum(cov, 0))
        return dataclasses.replace(self, weights=weights, means=mean, cov=cov)


    def flaw(self) -> str | None:
        """What is wrong with the parameters, if anything."""
        if not np.isfinite(self.means).all() or (self.cov is not None and not np.isfinite(self.cov).all()):
            return "parameters are not finite"
        if self.kind in ("full", "tied"):
            try:
                np.linalg.cholesky(self.cov)
            except np.linalg.LinAlgError:
                return "a covariance is singular"
        elif self.kind != "kmeans" and self.cov.min() <= 0:
            return "a variance is zero"
        return None


def additive(floor: float = 1e-6):
    return lambda v: v + floor


def adaptive(alpha: float = 1e-2, least: float = 1e-12):
    return lambda v: v + np.maximum(alpha * v, least)


def _blocks(frames: Iterator[pd.DataFrame], fits: list[Fit]) -> Iterator[tuple[int, np.ndarray, pd.DataFrame]]:
    """(position of a fit, rows of it as a matrix, their frame), a bounded block at a time."""
    for f in frames:
        for layer, g in f.groupby("layer", sort=False):
            step = max(1, SLICE // len(g["x"].iloc[0]))
            for a in range(0, len(g), step):
                part = g.iloc[a : a + step]
                x = np.stack(part["x"].to_numpy())
                for i, fit in enumerate(fits):
                    if fit.layer is None or fit.layer == layer:
                        keep = part[fit.use].to_numpy() if fit.use else slice(None)
                        if len(part[keep]):
                            yield i, x[keep], part[keep]


def _columns(states: DataFrame, fits: list[Fit]) -> DataFrame:
    return states.select("row_id", "layer", "x", *sorted({f.use for f in fits if f.use}))


def _summed(states: DataFrame, fits: list[Fit], of) -> dict[int, np.ndarray]:
    """``of(fit, rows)``, matrices that add up, over all rows of each fit."""

    def run(frames):
        held: dict[int, np.ndarray] = {}
        for i, x, _ in _blocks(frames, fits):
            made = of(fits[i], x)
            held[i] = held[i] + made if i in held else made
        for i, m in held.items():
            yield pd.DataFrame({"fit": i, "r": range(len(m)), "v": list(m)})

    parts = _columns(states, fits).mapInPandas(run, "fit int, r int, v array<double>")
    got = parts.select("fit", "r", F.posexplode("v").alias("c", "v")).groupBy("fit", "r", "c").agg(F.sum("v").alias("v")).toPandas()  # parameters' size
    out = {}
    for i, g in got.groupby("fit"):
        m = np.zeros((g["r"].max() + 1, g["c"].max() + 1))
        m[g["r"], g["c"]] = g["v"]
        out[int(i)] = m
    return out


def _least(states: DataFrame, fits: list[Fit], cost, seed: str) -> dict[int, np.ndarray]:
    """Per fit the row of the least -ln(u) / weight, u a hash of the row and ``cost(fit, rows)``
    the weights: a row drawn with chances in proportion to its weight."""
    named = _columns(states, fits).withColumn("u", uniform(seed, F.col("layer"), F.col("row_id")))

    def run(frames):
        best: dict[int, tuple] = {}
        for i, x, part in _blocks(frames, fits):
            w = cost(fits[i], x)
            # the same hash serves all fits of a row: turned by a step of its own for each start
            u = (part["u"].to_numpy() + 0.6180339887498949 * (fits[i].start + 1)) % 1.0
            c = np.where(w > 0, -np.log1p(-u) / np.maximum(w, 1e-300), np.inf)
            at = int(c.argmin())
            if np.isfinite(c[at]) and (i not in best or c[at] < best[i][0]):
                best[i] = (float(c[at]), x[at])
        if best:
            yield pd.DataFrame({"fit": list(best), "c": [b[0] for b in best.values()], "x": [b[1] for b in best.values()]})

    got = named.mapInPandas(run, "fit int, c double, x array<double>").groupBy("fit").agg(F.min_by("x", F.struct("c", "x")).alias("x")).collect()  # a row a fit
    return {r.fit: np.array(r.x) for r in got}


def seeded(states: DataFrame, fits: list[Fit], seed: int = 0) -> list[Fit]:
    """Fits with first centres: rows drawn one a round, the first evenly, the others with
    chances in proportion to the squared distance from the nearest one drawn. A layer with
    fewer distinct rows than k repeats one of them."""
    means: list[list[np.ndarray]] = [[] for _ in fits]
    for r in range(max(f.k for f in fits)):
        live = [i for i, f in enumerate(fits) if f.k > r]
        told = [dataclasses.replace(fits[i], kind="kmeans", k=max(r, 1), means=np.stack(means[i]) if r else None) for i in live]
        cost = (lambda f, x: -f.joint(x).max(1)) if r else (lambda f, x: np.ones(len(x)))
        drawn = _least(states, told, cost, f"{seed}|{r}")
        for at, i in enumerate(live):
            means[i].append(drawn[at] if at in drawn else means[i][0])
    return [dataclasses.replace(f, means=np.stack(m)) for f, m in zip(fits, means)]


def _hard(states: DataFrame, fits: list[Fit], regular) -> list[Fit]:
    """Weights and covariances of the rows nearest to each centre, centres as they are."""
    near = [dataclasses.replace(f, kind="kmeans") for f in fits]

    def of(f, x):
        full = fits[next(i for i, n in enumerate(near) if n is f)].kind in ("full", "tied")
        r = f.shares(x)[0]
        rows = []
        for c in range(f.k):
            d = x - f.means[c]
            rows.append(np.concatenate([[r[:, c].sum()], r[:, c] @ d, ((d.T * r[:, c]) @ d if full else r[:, c] @ (d * d)).ravel()]))
        return np.stack([*rows, np.zeros(len(rows[0]))])

    sums = _summed(states, near, of)
    out = []
    for i, f in enumerate(fits):
        made = f.moved(sums[i], {}, np.ones(f.means.shape[1]), regular)
        out.append(dataclasses.replace(made, means=f.means))
    return out


def _spreads(states: DataFrame, fits: list[Fit]) -> list[np.ndarray]:
    sums = _summed(states, fits, lambda f, x: np.stack([np.full(x.shape[1], len(x)), (x - f.means[0]).sum(0), ((x - f.means[0]) ** 2).sum(0)]))
    return [np.maximum(sums[i][2] / sums[i][0] - (sums[i][1] / sums[i][0]) ** 2, 1e-12) for i in range(len(fits))]


def step(states: DataFrame, fits: list[Fit], regular=None, seed: int = 0, spreads: list[np.ndarray] | None = None) -> list[Fit]:
    """One step of every fit. A component with no more than 1e-8 rows starts anew from a row
    drawn by hash."""
    regular = regular or additive()
    sums = _summed(states, fits, lambda f, x: f.moments(x))
    fresh: list[dict[int, np.ndarray]] = [{} for _ in fits]
    for c in range(max(f.k for f in fits)):
        dead = [i for i, f in enumerate(fits) if c < f.k and sums[i][c, 0] <= DEAD]
        if dead:
            drawn = _least(states, [fits[i] for i in dead], lambda f, x: np.ones(len(x)), f"dead|{seed}|{c}|{max(fits[i].steps for i in dead)}")
            for at, i in enumerate(dead):
                fresh[i][c] = drawn[at]
    if any(fresh):
        spreads = spreads or _spreads(states, fits)
    out = []
    for i, f in enumerate(fits):
        made = f.moved(sums[i], fresh[i], spreads[i] if fresh[i] else None, regular)
        if flaw := made.flaw():
            made = dataclasses.replace(f, failed=flaw)
        out.append(dataclasses.replace(made, steps=f.steps + 1, history=[*f.history, sums[i][-1, 1] / sums[i][-1, 0]]))
    return out


def fit(states: DataFrame, fits: list[Fit], iterations: int = 200, tolerance: float = 1e-5, regular=None, seed: int = 0) -> list[Fit]:
    """Fits of ``states(row_id, layer, x)`` to convergence: each stops once its score changes by
    no more than ``tolerance``, and those still moving share the next job. Fits without centres
    are seeded; those with centres (a continued fit) go on from them. A layer needs a row."""
    regular = regular or additive()
    bare = [i for i, f in enumerate(fits) if f.means is None]
    now = list(fits)
    if bare:
        for i, f in zip(bare, seeded(states, [fits[i] for i in bare], seed)):
            now[i] = f
    plain = [i for i, f in enumerate(now) if f.kind != "kmeans" and f.cov is None]
    if plain:
        for i, f in zip(plain, _hard(states, [now[i] for i in plain], regular)):
            now[i] = dataclasses.replace(f, failed=f.flaw())
    live = [i for i, f in enumerate(now) if not f.failed]
    for _ in range(iterations if live else 0):
        for i, f in zip(live, step(states, [now[i] for i in live], regular, seed)):
            now[i] = dataclasses.replace(f, converged=bool(len(f.history) > 1 and abs(f.history[-1] - f.history[-2]) <= tolerance))
        live = [i for i in live if not now[i].converged and not now[i].failed]
        if not live:
            break
    good = [i for i, f in enumerate(now) if not f.failed]
    sums = _summed(states, [now[i] for i in good], lambda f, x: np.array([[len(x), f.shares(x)[1].sum()]])) if good else {}
    for at, i in enumerate(good):
        now[i] = dataclasses.replace(now[i], score=float(sums[at][0, 1] / sums[at][0, 0]))
    return now


def best(fits: list[Fit], key=lambda f: f.layer) -> dict:
    """The fit of the greatest score per key, the first of equals."""
    out: dict = {}
    for f in fits:
        if key(f) not in out or f.score > out[key(f)].score:
            out[key(f)] = f
    return out


def criteria(states: DataFrame, fits: list[Fit]) -> list[tuple[int, float, float]]:
    """(rows, BIC, ICL) of each fit of diagonal, spherical, tied or full kind: ICL adds twice the
    entropy of the responsibilities."""

    def of(f, x):
        r, ll = f.shares(x)
        return np.array([[len(x), ll.sum(), -(r * np.log(np.maximum(r, 1e-300))).sum()]])

    sums, out = _summed(states, fits, of), []
    for i, f in enumerate(fits):
        n, ll, h = sums[i][0]
        d = f.means.shape[1]
        free = {"diag": f.k * d, "spherical": f.k, "tied": d * (d + 1) // 2, "full": f.k * d * (d + 1) // 2}[f.kind]
        value = -2 * ll + (f.k * d + free + f.k - 1) * np.log(n)
        out.append((int(n), float(value), float(value + 2 * h)))
    return out


def posterior(states: DataFrame, fits: list[Fit]) -> DataFrame:
    """(row_id, layer, fit, state, logp, shares): the likeliest component of each row under each
    fit that covers it, log density, and responsibilities."""

    def run(frames):
        for i, x, part in _blocks(frames, [dataclasses.replace(f, use=None) for f in fits]):
            r, ll = fits[i].shares(x)
            yield pd.DataFrame({"row_id": part["row_id"], "layer": part["layer"], "fit": i, "state": r.argmax(1), "logp": ll, "shares": list(r)})

    return states.select("row_id", "layer", "x").mapInPandas(run, "row_id long, layer int, fit int, state int, logp double, shares array<double>")


def minibatch(states: DataFrame, sizes: dict[int, int], batch: int = 1024, steps: int = 100, patience: int = 10, seed: int = 0) -> list[Fit]:
    """Mini-batch k-means: a step moves each centre towards the mean of the rows of a hash-drawn
    batch of about ``batch`` rows a layer, by their share in all rows that it ever met; a centre
    that meets less than a hundredth of the fullest one's starts anew from a row. A fit ends
    after ``patience`` steps without a better smoothed score."""
    fits = seeded(states, [Fit(layer, k, kind="kmeans") for layer, k in sizes.items()], seed)
    count = {r.layer: r.n for r in states.groupBy("layer").agg(F.count("*").alias("n")).collect()}  # a row a layer
    met = [np.zeros(f.k) for f in fits]
    smooth, peak, idle = [None] * len(fits), [float("-inf")] * len(fits), [0] * len(fits)
    live = list(range(len(fits)))
    share = F.create_map(*(F.lit(v) for layer, n in count.items() for v in (layer, min(1.0, batch / n))))
    for t in range(steps):
        some = states.where(uniform(f"batch|{seed}|{t}", F.col("layer"), F.col("row_id")) < F.element_at(share, F.col("layer")))
        sums = _summed(some, [fits[i] for i in live], lambda f, x: f.moments(x))
        for at, i in enumerate(list(live)):
            if at not in sums:
                continue
            f, m = fits[i], sums[at]
            d = f.means.shape[1]
            met[i] += m[:-1, 0]
            means = f.means + m[:-1, 1 : d + 1] / np.maximum(met[i], 1)[:, None]
            score = m[-1, 1] / m[-1, 0]
            part = min(1.0, 2.0 * m[-1, 0] / (count[f.layer] + 1))
            smooth[i] = score if smooth[i] is None else smooth[i] * (1 - part) + score * part
            idle[i] = 0 if smooth[i] > peak[i] else idle[i] + 1
            peak[i] = max(peak[i], smooth[i])
            fits[i] = dataclasses.replace(f, means=means, weights=met[i] / met[i].sum(), steps=t + 1, history=[*f.history, score], converged=bool(idle[i] >= patience))
        live = [i for i in live if not fits[i].converged]
        for c in range(max(f.k for f in fits)) if t % 10 == 0 else ():
            low = [i for i in live if c < fits[i].k and met[i][c] < 0.01 * met[i].max()]
            drawn = _least(some, [fits[i] for i in low], lambda f, x: np.ones(len(x)), f"low|{seed}|{t}|{c}") if low else {}
            for at, i in enumerate(low):
                if at in drawn:
                    fits[i].means[c], met[i][c] = drawn[at], met[i][np.arange(fits[i].k) != c].min(initial=met[i].max())
        if not live:
            break
    sums = _summed(states, fits, lambda f, x: np.array([[len(x), f.shares(x)[1].sum()]]))
    return [dataclasses.replace(f, score=float(sums[i][0, 1] / sums[i][0, 0])) for i, f in enumerate(fits)]
