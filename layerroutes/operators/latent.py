"""Latent classes of routes: mixtures of layer-wise Markov chains, and hidden Markov models over
layers, fitted by EM with Dirichlet smoothing.

A route is an array ``z`` of state codes, a code a layer. Both models live in column expressions:
log parameters are nested arrays in a table of one row, a route's chances are folds over its
layers in log space, and expected counts are rows (what is counted, weight) that Spark sums. Equal
routes are counted once and weighted. Only sums over the vocabulary reach the driver."""

import math
import random
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.functions.arrays import let, log_sum_exp, numbers

MATRIX = "array<array<double>>"


def paths(routes: DataFrame) -> DataFrame:
    """(row_id, z) from (row_id, layer, state)."""
    z = F.transform(F.sort_array(F.collect_list(F.struct("layer", "state"))), lambda s: s["state"])
    return routes.groupBy("row_id").agg(z.alias("z"))  # one route


def counted(rows: DataFrame) -> DataFrame:
    """(z, n): distinct routes and their rows."""
    return rows.groupBy("z").agg(F.count("*").cast("double").alias("n"))


def _drawn(size: int, *key) -> list[float]:
    """Logs of a random distribution over ``size`` outcomes, the same for the same key."""
    r = random.Random("|".join(map(str, key)))
    return _logs([r.expovariate(1.0) for _ in range(size)])


def _logs(counts: list[float], alpha: float = 0.0) -> list[float]:
    total = sum(counts) + alpha * len(counts)
    return [math.log(max((c + alpha) / total, 1e-300)) for c in counts]


def _beside(rows: DataFrame, p: dict) -> DataFrame:
    """``rows`` with the parameters as columns _w (array), _i and _t, _e (nested by layer)."""
    kinds = {"w": "array<double>", "i": MATRIX, "t": f"array<array<{MATRIX}>>" if "i" in p else f"array<{MATRIX}>", "e": f"array<{MATRIX}>"}
    names = [k for k in kinds if k in p]
    one = rows.sparkSession.createDataFrame([tuple(p[k] for k in names)], ", ".join(f"_{k} {kinds[k]}" for k in names))
    return rows.join(F.broadcast(one))  # one row, as large as the vocabulary


def _until(step, p: dict, iterations: int, tolerance: float) -> tuple[dict, list[float]]:
    """Steps p -> (p, mean log-likelihood under the p before) until the latter stands still."""
    history: list[float] = []
    for _ in range(iterations):
        p, ll = step(p)
        history.append(ll)
        if len(history) > 2 and abs(history[-1] - history[-2]) < tolerance:
            break
    return p, history


# Mixture of chains: class weights _w[j], first states _i[j][a], steps _t[l][j][a][b].


def _chance(j: Column, l: Column) -> Column:
    """Log chance of the state at layer ``l`` after the one before, in class ``j``."""
    first = F.get(F.get("_i", j), F.get("z", F.lit(0)))
    later = F.get(F.get(F.get(F.get("_t", l - 1), j), F.get("z", l - 1)), F.get("z", l))
    return F.when(l == 0, first).otherwise(later)


def class_joint(rows: DataFrame, p: dict) -> DataFrame:
    """``rows`` with joint, the log chance of the route together with each class."""
    both = lambda j: F.get("_w", j) + A.total(F.transform(numbers(F.size("z")), lambda l: _chance(j, l)))
    return _beside(rows, p).withColumn("joint", F.transform(numbers(F.size("_w")), both))


def class_counts(rows: DataFrame, m: int, more: Column | None = None) -> list:
    """Rows (layer, a, b, c0 .. c(m-1), ll) of expected counts of rows (z, n, share): state a
    at the layer before (-1 at the first) and b here; layer -1 holds the classes' own."""
    at = lambda l: F.struct(l.alias("layer"), F.when(l > 0, F.get("z", l - 1)).otherwise(-1).alias("a"), F.get("z", l).alias("b"))
    own = F.array(F.struct(F.lit(-1).alias("layer"), F.lit(-1).alias("a"), F.lit(-1).alias("b")))
    cells = rows.select("n", "share", (F.lit(0.0) if more is None else more).alias("ll"), F.explode(F.concat(own, F.transform(numbers(F.size("z")), at))).alias("cell"))
    sums = [F.sum(F.col("n") * F.col("share")[j]).alias(f"c{j}") for j in range(m)]
    return cells.groupBy("cell.layer", "cell.a", "cell.b").agg(*sums, F.sum(F.col("n") * F.col("ll")).alias("ll")).collect()  # the vocabulary's squares


def class_update(cells: list, sizes: list[int], m: int, alpha: float) -> dict:
    """Parameters from expected counts, each distribution smoothed by ``alpha``."""
    got = {(c.layer, c.a, c.b): [c[f"c{j}"] for j in range(m)] for c in cells}
    none = [0.0] * m
    line = lambda l, a, j: _logs([got.get((l, a, b), none)[j] for b in range(sizes[l])], alpha)
    return {
        "w": _logs(got[-1, -1, -1], alpha),
        "i": [line(0, -1, j) for j in range(m)],
        "t": [[[line(l, a, j) for a in range(sizes[l - 1])] for j in range(m)] for l in range(1, len(sizes))],
    }


def mixture(rows: DataFrame, sizes: list[int], m: int = 3, seed: int = 0, iterations: int = 10, alpha: float = 0.1, tolerance: float = 1e-5) -> tuple[dict, list[float]]:
    """Chains of ``m`` classes for rows (z) whose codes lie below ``sizes`` layer by layer.
    Gives (parameters, mean log-likelihood by step)."""
    routes = counted(rows).cache()
    total = routes.agg(F.sum("n")).first()[0]

    def step(p):
        e = class_joint(routes, p).withColumn("ll", log_sum_exp(F.col("joint")))
        e = e.withColumn("share", F.transform("joint", lambda v: F.exp(v - F.col("ll"))))
        cells = class_counts(e, m, F.col("ll"))
        return class_update(cells, sizes, m, alpha), next(c.ll for c in cells if c.layer == -1) / total

    start = {"w": _logs([1.0] * m), "i": [_drawn(sizes[0], seed, "first", j) for j in range(m)]}
    start["t"] = [[[_drawn(b, seed, l, j, x) for x in range(a)] for j in range(m)] for l, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    return _until(step, start, iterations, tolerance)


def mixture_losses(rows: DataFrame, p: dict) -> DataFrame:
    """(row_id, losses): minus log of each state's chance given those before it."""
    told = lambda s, l: F.transform(s["belief"], lambda v, j: v + _chance(j, l))

    def step(s: Column, l: Column) -> Column:
        after = lambda x: let(log_sum_exp(x), lambda ll: F.struct(F.transform(x, lambda v: v - ll).alias("belief"), F.array_append(s["losses"], -ll).alias("losses")))
        return let(told(s, l), after)

    start = F.struct(F.col("_w").alias("belief"), F.array().cast("array<double>").alias("losses"))
    return _beside(rows, p).select("row_id", F.aggregate(numbers(F.size("z")), start, step)["losses"].alias("losses"))


# Hidden chain: first classes _w[i], steps _t[l][i][j], emissions _e[l][j][a].


def _forward(depth: int) -> Column:
    """Log chances of the states up to each layer together with the class there."""
    emit = lambda l, j: F.get(F.get(F.get("_e", l), j), F.get("z", l))

    def step(f: Column, l: Column) -> Column:
        last = F.element_at(f, -1)
        reach = lambda j: log_sum_exp(F.transform(last, lambda v, i: v + F.get(F.get(F.get("_t", l - 1), i), j)))
        return F.array_append(f, F.transform(numbers(F.size("_w")), lambda j: emit(l, j) + reach(j)))

    first = F.array(F.transform("_w", lambda v, j: v + emit(F.lit(0), j)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth - 1)), first, step) if depth > 1 else first


def _ahead(depth: int) -> Column:
    """Per layer from the first on and class there: log chances of the states after it."""
    emit = lambda l, j: F.get(F.get(F.get("_e", l), j), F.get("z", l))

    def step(b: Column, l: Column) -> Column:
        nxt = F.get(b, F.lit(0))
        here = lambda i: log_sum_exp(F.transform(nxt, lambda v, j: v + emit(l + 1, j) + F.get(F.get(F.get("_t", l), i), j)))
        return F.concat(F.array(F.transform(numbers(F.size("_w")), here)), b)

    last = F.array(F.transform("_w", lambda v: v * 0.0))
    return F.aggregate(F.sequence(F.lit(depth - 2), F.lit(0), F.lit(-1)), last, step) if depth > 1 else last


def _hidden_counts(routes: DataFrame, p: dict) -> list:
    """Rows (kind, layer, a, b, c) of expected counts: first classes, steps and emissions, and
    the log-likelihood."""
    depth, m = len(p["e"]), len(p["w"])
    e = _beside(routes, p).withColumns({"f": _forward(depth), "g": _ahead(depth)}).withColumn("ll", log_sum_exp(F.element_at("f", -1)))
    cell = lambda kind, l, a, b, v: F.struct(F.lit(kind).alias("kind"), l.alias("layer"), a.alias("a"), b.alias("b"), v.alias("c"))
    here = lambda l, j: F.exp(F.get(F.get("f", l), j) + F.get(F.get("g", l), j) - F.col("ll"))
    classes, none = numbers(F.lit(m)), F.lit(-1)
    emitted = F.flatten(F.transform(numbers(F.lit(depth)), lambda l: F.transform(classes, lambda j: cell("emit", l, j, F.get("z", l), here(l, j)))))

    def moved(l: Column, i: Column, j: Column) -> Column:
        onward = F.get(F.get(F.get("_e", l + 1), j), F.get("z", l + 1)) + F.get(F.get("g", l + 1), j)
        return cell("step", l, i, j, F.exp(F.get(F.get("f", l), i) + F.get(F.get(F.get("_t", l), i), j) + onward - F.col("ll")))

    steps = F.flatten(F.transform(numbers(F.lit(depth - 1)), lambda l: F.flatten(F.transform(classes, lambda i: F.transform(classes, lambda j: moved(l, i, j))))))
    first = F.transform(classes, lambda j: cell("first", F.lit(0), j, none, here(F.lit(0), j)))
    whole = F.array(cell("all", none, none, none, F.col("ll")))
    cells = e.select("n", F.explode(F.concat(whole, first, steps, emitted) if depth > 1 else F.concat(whole, first, emitted)).alias("x"))
    return cells.groupBy("x.kind", "x.layer", "x.a", "x.b").agg(F.sum(F.col("n") * F.col("x.c")).alias("c")).collect()  # classes by vocabulary


def hidden(rows: DataFrame, sizes: list[int], m: int = 3, seed: int = 0, iterations: int = 10, alpha: float = 0.1, tolerance: float = 1e-5) -> tuple[dict, list[float]]:
    """A hidden chain of ``m`` classes with steps and emissions of each layer's own."""
    routes = counted(rows).cache()
    total = routes.agg(F.sum("n")).first()[0]

    def step(p):
        c: dict = defaultdict(float)
        for r in _hidden_counts(routes, p):
            c[r.kind, r.layer, r.a, r.b] = r.c
        line = lambda kind, l, a, n: _logs([c[kind, l, a, b] for b in range(n)], alpha)
        made = {
            "w": _logs([c["first", 0, j, -1] for j in range(m)], alpha),
            "t": [[line("step", l, i, m) for i in range(m)] for l in range(len(sizes) - 1)],
            "e": [[line("emit", l, j, k) for j in range(m)] for l, k in enumerate(sizes)],
        }
        return made, c["all", -1, -1, -1] / total

    start = {"w": _logs([1.0] * m), "t": [[_drawn(m, seed, "step", l, i) for i in range(m)] for l in range(len(sizes) - 1)]}
    start["e"] = [[_drawn(k, seed, "emit", l, j) for j in range(m)] for l, k in enumerate(sizes)]
    return _until(step, start, iterations, tolerance)


def hidden_losses(rows: DataFrame, p: dict) -> DataFrame:
    """(row_id, losses): minus log of each state's chance given those before it."""
    upto = _beside(rows, p).select("row_id", F.transform(_forward(len(p["e"])), log_sum_exp).alias("upto"))
    return upto.select("row_id", F.transform("upto", lambda v, l: F.when(l == 0, -v).otherwise(F.get("upto", l - 1) - v)).alias("losses"))
