"""Alignment of states from layer to layer. All tables have K rows a layer."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A


def similarities(centers: DataFrame, metric: str = "cosine") -> DataFrame:
    """Similarities of consecutive layers' centres: (layer, a, b, sim); layer is the later."""
    before = centers.select("layer").distinct().select("layer", F.lag("layer").over(Window.orderBy("layer")).alias("prev"))  # a row a layer
    nxt = centers.join(before, "layer").select(F.col("prev").alias("layer"), F.col("layer").alias("later"), F.col("state").alias("b"), F.col("mu").alias("y"))
    sim = A.cosine(F.col("mu"), F.col("y")) if metric == "cosine" else 1 / (1 + F.sqrt(A.sq_dist(F.col("mu"), F.col("y"))))
    return centers.withColumnRenamed("state", "a").join(nxt, "layer").select(F.col("later").alias("layer"), "a", "b", sim.alias("sim"))


def greedy(sims: DataFrame, by: list[str], threshold: float = 0.0) -> DataFrame:
    """Greedy one-to-one matching within ``by``: highest first, lower ids first among equals.
    Each round takes the pairs that are best for both of their ends."""
    left, out = sims.where(F.col("sim") >= threshold), None
    while True:
        key = F.struct(F.col("sim").alias("s"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
        ka, kb = (left.groupBy(*by, c).agg(F.max(key).alias(f"k{c}")) for c in ("a", "b"))
        best = left.join(ka, [*by, "a"]).join(kb, [*by, "b"]).where((F.col("ka") == key) & (F.col("kb") == key)).select(*by, "a", "b", "sim")
        rows = best.collect()  # at most K a layer
        if not rows:
            break
        best = left.sparkSession.createDataFrame(rows, best.schema)
        out = best if out is None else out.union(best)
        left = left.join(F.broadcast(best.select(*by, "a")), [*by, "a"], "left_anti").join(F.broadcast(best.select(*by, "b")), [*by, "b"], "left_anti")
    return out if out is not None else sims.limit(0)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a least-cost assignment of rows to columns, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return [(j, i) for i, j in assignment(cost.T)]
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, back, done = cost[row] - u[row] - v, np.full(m, -1), np.zeros(m, bool)
        while True:
            j = int(np.argmin(np.where(done, np.inf, dist)))
            low, done[j] = dist[j], True
            if owner[j] < 0:
                break
            i = owner[j]
            step = low + cost[i] - u[i] - v - (cost[i, j] - u[i] - v[j])
            better = ~done & (step < dist)
            dist[better], back[better] = step[better], j
        seen = np.flatnonzero(done)
        for k in seen:
            if owner[k] >= 0:
                u[owner[k]] += low - dist[k]
            v[k] -= low - dist[k]
        u[row] += low
        while back[j] >= 0:
            owner[j], j = owner[back[j]], back[j]
        owner[j] = row
    return [(int(i), int(j)) for j, i in enumerate(owner) if i >= 0]


def optimal(sims: DataFrame, threshold: float = 0.0, allow_negative: bool = False, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Optimal one-to-one matching per ``by``; negative similarities count as 0 unless allowed.
    Pairs whose own similarity is under the threshold go after matching."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        a, b = np.sort(f["a"].unique()), np.sort(f["b"].unique())
        raw = np.full((len(a), len(b)), -1e6)
        raw[np.searchsorted(a, f["a"]), np.searchsorted(b, f["b"])] = f["sim"]
        s = raw if allow_negative else np.where(raw > -1e6, np.maximum(raw, 0), raw)
        rows = [(*(int(f[c].iloc[0]) for c in by), int(a[i]), int(b[j]), float(raw[i, j])) for i, j in assignment(-s) if raw[i, j] >= threshold]
        return pd.DataFrame(rows, columns=[*by, "a", "b", "sim"])

    return sims.groupBy(*by).applyInPandas(one, ", ".join(f"{c} int" for c in by) + ", a int, b int, sim double")  # K x K a group


def align_layers(centers: DataFrame, matches: DataFrame) -> DataFrame:
    """Global ids (layer, local_state, state): the first layer keeps its order, matches inherit,
    others are born in local order. The driver walks over K states a layer."""
    spark = centers.sparkSession
    local: dict[int, list[int]] = {}
    for r in centers.select("layer", "state").distinct().collect():
        local.setdefault(r.layer, []).append(r.state)
    pairs = {(r.layer, r.b): r.a for r in matches.collect()}
    vocab, new = {}, 0
    order = sorted(local)
    for k, layer in enumerate(order):
        for s in sorted(local[layer]):
            old = vocab.get((order[k - 1], pairs[layer, s])) if k and (layer, s) in pairs else None
            if old is None:
                old, new = new, new + 1
            vocab[layer, s] = old
    return spark.createDataFrame([(a, b, c) for (a, b), c in sorted(vocab.items())], "layer int, local_state int, state int")


def _centres(centers: DataFrame) -> dict[int, tuple[list[int], np.ndarray]]:
    """K centres a layer, on the driver."""
    out: dict[int, list] = {}
    for r in centers.orderBy("layer", "state").collect():
        out.setdefault(r.layer, []).append((r.state, r.mu))
    return {k: ([s for s, _ in v], np.array([m for _, m in v])) for k, v in out.items()}


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return unit(a) @ unit(b).T


def to_pool(centers: DataFrame, threshold: float | None = None, anchor: int | None = None) -> DataFrame:
    """Global ids (layer, local_state, state, pool): each layer is matched with all centres seen
    so far, or with the ``anchor`` layer alone. What finds no partner of ``threshold`` is born;
    pool is the number of known ids after the layer. Works on K centres a layer."""
    given = _centres(centers)
    order = sorted(given) if anchor is None else [anchor, *(k for k in sorted(given) if k != anchor)]
    pool, out, born = np.zeros((0, 0)), [], 0
    for layer in order:
        local, mu = given[layer]
        pairs = {}
        if len(pool):
            sim = _cosines(pool, mu)
            pairs = {j: i for i, j in assignment(-sim) if threshold is None or sim[i, j] >= threshold}
        fresh = [j for j in range(len(local)) if j not in pairs]
        ids = pairs | {j: born + k for k, j in enumerate(fresh)}
        if anchor is None or layer == anchor:
            pool = mu if not len(pool) else np.vstack([pool, mu[fresh]])
        born += len(fresh)
        out += [(layer, s, int(ids[j]), born) for j, s in enumerate(local)]
    return centers.sparkSession.createDataFrame(out, "layer int, local_state int, state int, pool int")
