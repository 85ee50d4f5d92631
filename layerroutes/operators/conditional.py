"""Cross-fitted models of a label from categories and smooth numeric terms, compared with a
baseline set of terms on rows that no model was fitted to."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.functions.hashing import uniform
from layerroutes.functions.stats import auroc, place
from layerroutes.sources.scratch import cut

KNOTS = 5


def cubic_splines(x: Column, low: float, high: float, knots: int = KNOTS) -> Column:
    """Cubic B-splines over ``knots`` even knots from ``low`` to ``high``, all but the last, as an
    array; beyond the ends the values at the ends hold. The splines are shifts of one piecewise
    cubic bump, so each is a polynomial of the distance from its left end."""
    step = (high - low) / (knots - 1) or 1.0
    u = F.least(F.greatest((x - low) / step, F.lit(0.0)), F.lit(float(knots - 1)))

    def bump(s: Column) -> Column:
        rise, fall = s * s * s / 6, (4 - s) * (4 - s) * (4 - s) / 6
        inner = lambda v: (-3 * v * v * v + 12 * v * v - 12 * v + 4) / 6
        return F.when((s <= 0) | (s >= 4), 0.0).when(s < 1, rise).when(s < 2, inner(s)).when(s < 3, inner(4 - s)).otherwise(fall)

    starts = F.array(*(F.lit(float(k - 3)) for k in range(knots + 1)))
    return A.let(u, lambda v: F.transform(starts, lambda k: A.let(v - k, lambda s: bump(s))))


def one_hot(c: Column, levels: list) -> Column:
    """1 at the level of ``c``; a value that is none of ``levels`` has zeros everywhere."""
    return F.transform(F.lit(levels), lambda v: F.coalesce((c == v).cast("double"), F.lit(0.0)))


def stratified_folds(rows: DataFrame, ident: str, label: str, folds: int, salt: str) -> DataFrame:
    """``rows`` with fold: within each class, rows in hash order are dealt out in turn, so fold
    sizes of a class differ by one at most."""
    ranked = place(rows, [label], uniform(salt, F.col(ident)), "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def design(train: DataFrame, categories: list[str], numbers: list[str]) -> Column:
    """The terms as one array; levels and ranges are those of ``train``."""
    got = train.agg(*(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(f"c{i}") for i, c in enumerate(categories)), *(f(n).alias(f"{k}{i}") for i, n in enumerate(numbers) for k, f in (("lo", F.min), ("hi", F.max)))).first()  # levels and ends
    parts = [one_hot(F.col(c).cast("string"), got[f"c{i}"]) for i, c in enumerate(categories) if got[f"c{i}"]]
    parts += [cubic_splines(F.col(n), got[f"lo{i}"], got[f"hi{i}"]) for i, n in enumerate(numbers)]
    return F.concat(*parts)


def _linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -500, 500)))


def logistic(rows: DataFrame, models: list[tuple[str, int]], penalty: float = 1.0, steps: int = 30) -> list[np.ndarray]:
    """Weights, intercept first, of a logistic model for each (column of terms, fold left out):
    Newton steps on the log loss plus half the squared weights. A step is one pass for all
    models; a task adds up each model's matrix, whose size the terms bound."""
    columns = sorted({c for c, _ in models})
    sizes = rows.select(*(F.size(c).alias(c) for c in columns)).first()
    now = [np.zeros(sizes[c] + 1) for c, _ in models]
    data = rows.select("fold", "y", *columns)
    for _ in range(steps):

        def run(frames, now=tuple(now)):
            held = {}
            for f in frames:
                for i, (c, fold) in enumerate(models):
                    g = f[f["fold"] != fold]
                    if not len(g):
                        continue
                    x = np.column_stack([np.ones(len(g)), np.stack(g[c].to_numpy())])
                    p = _linear(x[:, 1:], now[i])
                    m = np.column_stack([(x.T * (p * (1 - p))) @ x, x.T @ (p - g["y"].to_numpy())])
                    held[i] = held.get(i, 0) + m
            for i, m in held.items():
                yield pd.DataFrame({"model": i, "r": range(len(m)), "v": list(m)})

        got = data.mapInPandas(run, "model int, r int, v array<double>").select("model", "r", F.posexplode("v").alias("c", "v")).groupBy("model", "r", "c").agg(F.sum("v").alias("v")).toPandas()  # terms squared
        moved = 0.0
        for i, g in got.groupby("model"):
            k = len(now[i])
            m = np.zeros((k, k + 1))
            m[g["r"], g["c"]] = g["v"]
            ridge = penalty * np.eye(k)
            ridge[0, 0] = 1e-9
            move = np.linalg.solve(m[:, :k] + ridge, m[:, k] + ridge @ now[i])
            # a step is cut where it would leave the region in which the loss is nearly a square
            now[i] = now[i] - move * min(1.0, 10.0 / max(np.abs(move).max(), 1e-12))
            moved = max(moved, np.abs(move).max())
        if moved < 1e-8:
            break
    return now


def cross_fitted(rows: DataFrame, ident: str, label: str, categories: list[str], configs: dict[str, list[str]], folds: int = 5, model: str = "logistic", salt: str = "folds") -> DataFrame:
    """(ident, label, config, fold, p): for each named set of numeric terms the chance of label 1,
    from a model that saw the other folds. Models are ``logistic`` (squared penalty of weight 1)
    or ``trees`` (boosted)."""
    dealt = cut(stratified_folds(rows, ident, label, folds, salt).withColumn("y", F.col(label).cast("double")))
    made = {(name, fold): design(dealt.where(F.col("fold") != fold), categories, numbers) for name, numbers in configs.items() for fold in range(folds)}
    if model == "logistic":
        keys = {k: f"terms_{i}" for i, k in enumerate(made)}
        wide = dealt.withColumns({keys[k]: x for k, x in made.items()})
        weights = dict(zip(made, logistic(wide, [(keys[k], k[1]) for k in made])))
        score = lambda w, x: 1 / (1 + F.exp(-(w[0] + A.dot(x, F.lit(w[1:].tolist())))))
        each = [F.struct(F.lit(name).alias("config"), score(weights[name, fold], F.col(keys[name, fold])).alias("p"), F.lit(fold).alias("left")) for name, fold in made]
        out = wide.select(ident, label, "fold", F.explode(F.filter(F.array(*each), lambda e: e["left"] == F.col("fold"))).alias("e"))
        return out.select(ident, label, "e.config", "fold", "e.p")
    if model != "trees":
        raise ValueError(f"no such model: {model}")
    parts = []
    for (name, fold), x in made.items():
        side = dealt.select(ident, label, "fold", "y", array_to_vector(x).alias("f"))
        fitted = GBTClassifier(labelCol="y", featuresCol="f", maxIter=10, maxDepth=3, seed=0).fit(side.where(F.col("fold") != fold).coalesce(4))
        scored = fitted.transform(side.where(F.col("fold") == fold))
        parts.append(scored.select(ident, label, F.lit(name).alias("config"), "fold", vector_to_array("probability")[1].alias("p")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def compared(scored: DataFrame, label: str, baseline: str) -> DataFrame:
    """Per config: rows, AUROC and log loss over all folds, and both less the baseline's."""
    p, y = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15)), F.col(label)
    loss = scored.groupBy("config").agg(F.count("*").alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    g = loss.join(auroc(scored, "p", label, ["config"]).select("config", "auroc"), "config")
    base = g.where(F.col("config") == baseline).select(F.col("auroc").alias("_a"), F.col("log_loss").alias("_l"))
    return g.join(F.broadcast(base)).select("config", "n", "auroc", "log_loss", (F.col("auroc") - F.col("_a")).alias("auroc_gain"), (F.col("log_loss") - F.col("_l")).alias("loss_gain"))  # one row
