"""How far a discretisation depends on seed, sample and the largest K tried."""

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerroutes.functions.hashing import uniform
from layerroutes.operators.align import assignment
from layerroutes.operators.mixtures import Fit, fit


@dataclasses.dataclass
class Variant:
    """A way to refit: another seed, or a hash-drawn share of the rows."""

    name: str
    start: int = 0
    fraction: float = 1.0


def bic(f: Fit, n: int) -> float:
    d = f.means.shape[1]
    return -2 * n * f.score + (2 * f.k * d + f.k - 1) * math.log(n)


def refits(states: DataFrame, variants: list[Variant], ks: list[int], iterations: int = 50, tolerance: float = 1e-4) -> dict[tuple[str, int, int], tuple[Fit, float]]:
    """{(variant, layer, k): (fit, criterion)} of diagonal mixtures. All variants, layers and
    sizes step in the same jobs; a subsample is a column of the rows, not a copy."""
    layers = [r.layer for r in states.select("layer").distinct().orderBy("layer").collect()]  # a row a layer
    part = {v.name: f"use_{i}" for i, v in enumerate(variants) if v.fraction < 1}
    rows = states.withColumns({part[v.name]: uniform(f"refit|{v.name}", F.col("row_id")) < v.fraction for v in variants if v.name in part})
    keys = [(v, layer, k) for v in variants for layer in layers for k in ks]
    fits = fit(rows, [Fit(layer, k, v.start, use=part.get(v.name)) for v, layer, k in keys], iterations, tolerance)
    counts = rows.groupBy("layer").agg(*(F.count(F.when(F.col(part[v.name]), 1) if v.name in part else F.lit(1)).alias(f"n{i}") for i, v in enumerate(variants))).collect()  # a row a layer
    n = {(v.name, r.layer): r[f"n{i}"] for r in counts for i, v in enumerate(variants)}
    return {(v.name, layer, k): (f, bic(f, n[v.name, layer])) for (v, layer, k), f in zip(keys, fits)}


def k_curve(made: dict, variant: str, k_max: int | None = None) -> dict[int, int]:
    """{layer: K of the least criterion} among sizes up to ``k_max``; the smaller of equals."""
    out: dict[int, tuple] = {}
    for (name, layer, k), (_, c) in made.items():
        if name == variant and (k_max is None or k <= k_max):
            out[layer] = min(out.get(layer, (c, k)), (c, k))
    return {layer: k for layer, (_, k) in out.items()}


def matched_distance(a: np.ndarray, b: np.ndarray) -> float:
    """One minus the mean cosine of the best one-to-one pairs of two sets of centres."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sim = unit(a) @ unit(b).T
    return 1.0 - float(np.mean([sim[i, j] for i, j in assignment(-sim)]))


def persistence(made: dict, baseline: str, draws: int = 3, seed: int = 0) -> list[tuple]:
    """Rows (variant, layer, k, distance): each variant's centres at the baseline's K against the
    baseline's, and ``draws`` sets of normal centres (variants random0 ..)."""
    out = []
    for layer, k in k_curve(made, baseline).items():
        base = made[baseline, layer, k][0].means
        for name in dict.fromkeys(key[0] for key in made):
            if name != baseline:
                out.append((name, layer, k, matched_distance(base, made[name, layer, k][0].means)))
        for r in range(draws):
            out.append((f"random{r}", layer, k, matched_distance(base, np.random.default_rng([seed, r, layer]).normal(size=base.shape))))
    return out


def against(pairs: DataFrame, baseline: str, a: str = "a", b: str = "b") -> DataFrame:
    """Rows of comparisons ``pairs`` that have the declared baseline on either side, with column
    other for the side that is compared with it."""
    other: Column = F.when(F.col(a) == baseline, F.col(b)).when(F.col(b) == baseline, F.col(a))
    return pairs.where(F.col(a) != F.col(b)).withColumn("other", other).where("other is not null")
