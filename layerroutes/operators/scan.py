"""Scans over K: a row a layer and K with criteria, silhouette and stability of converged fits."""

import dataclasses
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerroutes.functions.hashing import uniform
from layerroutes.operators import mixtures as M
from layerroutes.operators.cluster import rand_by
from layerroutes.sources.scratch import cut

SCHEMA = "layer int, k int, n_samples long, bic double, icl double, steps int, converged boolean, failed string"


#: Blocks of rows at least, over all layers; numbers that a task holds of its block; rows of a chunk and of a tile.
TASKS, HELD, CHUNK, TILE = 32, 1 << 21, 4096, 64


class _Block:
    """Rows of one layer held against all of its rows: for each state of each fit (``ks`` has the
    fits' K) the sum of distances to its rows, and their number."""

    def __init__(self, ks: list[int], parts: list[tuple[np.ndarray, np.ndarray]]):
        self.ks, self.at = ks, np.cumsum([0, *ks])
        self.x, self.named = (np.concatenate(p) for p in zip(*parts))
        self.middle = self.x.mean(0)  # distances are taken about it, which costs fewer digits
        own = self.x - self.middle
        self.square = (own * own).sum(1)
        self.wide = np.concatenate([-2 * own.T, [self.square], np.ones((1, len(own)))])
        self.sums, self.count = np.zeros((self.at[-1], len(own))), np.zeros(self.at[-1])
        for p in parts:
            self.meet(*p)

    def meet(self, x: np.ndarray, named: np.ndarray) -> None:
        """Adds the distances to these rows. Squares come from products; where that would leave
        less than seven digits of them, from the differences."""
        own = x - self.middle
        square = (own * own).sum(1)
        left, largest = np.concatenate([own, np.ones((len(x), 1)), square[:, None]], 1), square.max()
        states = np.zeros((self.at[-1], len(x)))
        states[self.at[:-1] + named, np.arange(len(x))[:, None]] = 1
        self.count += states.sum(1)
        for a in range(0, len(self.x), TILE):
            d = left @ np.ascontiguousarray(self.wide[:, a : a + TILE])
            close = 1e-7 * (largest + self.square[a : a + TILE].max())
            if d.min() <= close:
                i, j = np.nonzero(d <= close)
                d[i, j] = ((x[i] - self.x[a + j]) ** 2).sum(1)
            self.sums[:, a : a + TILE] += states @ np.sqrt(d, out=d)

    def values(self) -> list[tuple[int, float, int]]:
        """(K, sum of the rows' silhouettes, rows) of each fit with two states or more."""
        out, each = [], np.arange(len(self.x))
        for f, k in enumerate(self.ks):
            sums, n, own = self.sums[self.at[f] : self.at[f + 1]], self.count[self.at[f] : self.at[f + 1]], self.named[:, f]
            if (n > 0).sum() < 2:
                continue
            means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], np.inf)
            means[own, each] = np.inf
            a, b = sums[own, each] / np.maximum(n[own] - 1, 1), means.min(0)
            out.append((k, float(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()), len(each)))
        return out


def named(states: DataFrame, fits: list[M.Fit]) -> DataFrame:
    """``states(row_id, layer, x)`` with each row's states under the fits of its layer, in their order."""

    def run(frames):
        for f in frames:
            for layer, g in f.groupby("layer", sort=False):
                if own := [fit for fit in fits if fit.layer == layer]:
                    x = np.stack(g["x"].to_numpy())
                    yield g.assign(named=list(np.stack([fit.shares(x)[0].argmax(1) for fit in own], 1)))

    return states.select("row_id", "layer", "x").mapInPandas(run, "row_id long, layer int, x array<double>, named array<int>")


def silhouettes(rows: DataFrame, ks: dict[int, list[int]], count: dict[int, int], width: dict[int, int]) -> DataFrame:
    """(layer, k, silhouette): mean Euclidean silhouette over all of ``rows(row_id, layer, x,
    named)``, ``named`` being a row's states under the layer's fits, of ``ks`` states; a row alone
    in its state counts 0, and one state alone has none. ``count`` and ``width`` have a layer's rows
    (at most) and the length of its vectors.

    Every pair of a layer's rows is met. A layer is cut into blocks by the hash of the id; a task
    holds one block, of no more than about ``HELD`` numbers, and reads the layer's rows, packed in
    chunks, once. So rows are sent once for each block, and only sums leave a task."""
    size = {layer: max(math.ceil(TASKS / len(ks)), math.ceil(count[layer] * width[layer] / HELD)) for layer in ks}
    first = dict(zip(size, itertools.accumulate(size.values(), initial=0)))
    of = lambda told: F.element_at(F.create_map(*(F.lit(v) for pair in told.items() for v in pair)), F.col("layer"))
    least = {layer: min(CHUNK, max(TILE, HELD // (2 * width[layer]))) for layer in ks}
    kind = np.min_scalar_type(max(k for own in ks.values() for k in own))

    def packed(layer, block, parts):
        x, z = (np.stack(pd.concat([p[c] for p in parts]).to_numpy()) for c in ("x", "named"))
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        x = short if (short == x).all() else x  # numbers that came as floats go as floats
        return pd.DataFrame({"layer": [layer], "block": [block], "n": [len(x)], "x": [x.tobytes()], "named": [z.astype(kind).tobytes()]})

    def pack(frames):
        held: dict[tuple[int, int], list[pd.DataFrame]] = {}
        kept = 0
        for f in frames:
            for key, g in f.groupby(["layer", "block"], sort=False):
                held.setdefault(key, []).append(g)
                kept += len(g) * width[key[0]]
                if sum(map(len, held[key])) >= least[key[0]] or kept >= HELD:
                    kept -= sum(map(len, held[key])) * width[key[0]]
                    yield packed(*key, held.pop(key))
        for key, parts in held.items():
            yield packed(*key, parts)

    def measure(frames):
        task, layer, own, block = None, None, [], None
        close = lambda: [(layer, *v) for v in (block or _Block(ks[layer], own)).values()] if own else []
        for f in frames:
            for r in f.itertuples(index=False):
                if r.task != task:
                    if made := close():
                        yield pd.DataFrame(made, columns=["layer", "k", "total", "n"])
                    task, layer, own, block = r.task, r.layer, [], None
                x = np.frombuffer(r.x, np.float32 if len(r.x) == r.n * width[layer] * 4 else float).reshape(r.n, -1).astype(float)
                part = x, np.frombuffer(r.named, kind).reshape(r.n, -1).astype(int)
                if r.own:
                    own.append(part)
                elif own:
                    block = block or _Block(ks[layer], own)
                    block.meet(*part)
        if made := close():
            yield pd.DataFrame(made, columns=["layer", "k", "total", "n"])

    dealt = rows.where(F.col("layer").isin(list(ks))).select("layer", F.pmod(F.xxhash64("row_id"), of(size)).cast("int").alias("block"), "x", "named")
    chunks = dealt.mapInPandas(pack, "layer int, block int, n int, x binary, named binary")
    each = chunks.withColumn("share", F.explode(F.sequence(F.lit(0), of(size) - 1))).select("layer", (of(first) + F.col("share")).alias("task"), (F.col("block") == F.col("share")).alias("own"), "n", "x", "named")
    met = each.repartitionById(sum(size.values()), "task").sortWithinPartitions("task", F.desc("own")).mapInPandas(measure, "layer int, k int, total double, n long")
    return met.groupBy("layer", "k").agg((F.sum("total") / F.sum("n")).alias("silhouette"))


@dataclasses.dataclass
class _Repeats:
    """Fits of one layer and K, whose states are named in one pass."""

    layer: int
    fits: list[M.Fit]
    use: str | None = None

    def pairs(self) -> list[tuple[int, int]]:
        return list(itertools.combinations(range(len(self.fits)), 2))

    def counted(self, x: np.ndarray) -> np.ndarray:
        """For each pair of fits how many rows have states a (rows) and b (columns)."""
        k, named = self.fits[0].k, [f.shares(x)[0].argmax(1) for f in self.fits]
        return np.concatenate([np.bincount(named[p] * k + named[q], minlength=k * k).reshape(k, k) for p, q in self.pairs()]).astype(float)


def tables(states: DataFrame, fits: list[M.Fit]) -> DataFrame:
    """(layer, k, p, q, a, b, n): rows in state a of the fit of start p and in state b of that of
    start q, for each two fits of a layer and K. Tasks count, so no row is shuffled; K * K
    numbers a pair reach the driver."""
    alike: dict[tuple[int, int], list[M.Fit]] = {}
    for f in sorted(fits, key=lambda f: f.start):
        alike.setdefault((f.layer, f.k), []).append(f)
    several = [_Repeats(layer, own) for (layer, _), own in alike.items() if len(own) > 1]
    sums = M._summed(states, several, lambda g, x: g.counted(x)) if several else {}
    rows = []
    for i, m in sums.items():
        g = several[i]
        k = g.fits[0].k
        for at, (p, q) in enumerate(g.pairs()):
            rows += [(g.layer, k, g.fits[p].start, g.fits[q].start, a, b, int(m[at * k + a, b])) for a in range(k) for b in range(k) if m[at * k + a, b]]
    return states.sparkSession.createDataFrame(rows, "layer int, k int, p int, q int, a int, b int, n long")


def scan(states: DataFrame, ks: list[int], repeats: int = 2, kind: str = "diag", eval_rows: int | None = None, iterations: int = 100, tolerance: float = 1e-5, seed: int = 0, regular=None) -> DataFrame:
    """(layer, k, n_samples, bic, icl, silhouette, stability, steps, converged, failed) for each
    layer and K of ``ks``. Criteria and silhouette are the first fit's, stability is the mean
    adjusted Rand index over pairs of ``repeats`` further fits from other starts. All fits step in
    the same jobs. A K of at least the layer's rows, or a fit that fails, is a row without
    measures that says why. The silhouette is that of all rows, so its work grows with the square
    of a layer; ``eval_rows``, if given, has it from so many ids, the first in a hash order."""
    spark = states.sparkSession
    n = {r.layer: r.n for r in states.groupBy("layer").agg(F.count("*").alias("n")).collect()}  # a row a layer
    fits = M.fit(states, [M.Fit(layer, k, s, kind) for layer in n for k in ks if k < n[layer] for s in range(repeats + 1)], iterations, tolerance, regular, seed)
    first = [f for f in fits if f.start == 0]
    good = [f for f in first if not f.failed]
    found = {(f.layer, f.k): c for f, c in zip(good, M.criteria(states, good))} if good else {}
    rows = [(layer, k, n[layer], None, None, None, None, f"{n[layer]} rows") for layer in n for k in ks if k >= n[layer]]
    for f in first:
        _, bic, icl = found.get((f.layer, f.k), (0, None, None))
        rows.append((f.layer, f.k, n[f.layer], bic, icl, f.steps, f.converged, f.failed))
    table = spark.createDataFrame(rows, SCHEMA)
    if not good:
        return table.withColumns({"silhouette": F.lit(None).cast("double"), "stability": F.lit(None).cast("double")})

    ks = {layer: [f.k for f in good if f.layer == layer] for layer in sorted({f.layer for f in good})}
    if eval_rows is None:
        rows = named(states, good)
    else:
        ids = states.where(F.col("layer").isin(list(ks))).select("row_id").distinct().orderBy(uniform("silhouette", F.col("row_id")), "row_id").limit(eval_rows)
        some = cut(states.join(F.broadcast(ids), "row_id"))  # ``eval_rows`` ids: states are named for these alone
        told = F.transform(F.sort_array(F.collect_list(F.struct("fit", "state"))), lambda s: s["state"])  # a number a fit
        rows = some.join(M.posterior(some, good).groupBy("row_id", "layer").agg(told.alias("named")), ["row_id", "layer"])
    measured = silhouettes(rows, ks, n, {f.layer: f.means.shape[1] for f in good})
    stable = rand_by(tables(states, [f for f in fits if f.start > 0 and not f.failed]), ["layer", "k", "p", "q"], "a", "b", "n").groupBy("layer", "k").agg(F.avg("ari").alias("stability"))
    return table.join(measured, ["layer", "k"], "left").join(stable, ["layer", "k"], "left")
