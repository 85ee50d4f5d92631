"""Quality rules with robust multivariate outliers.

Counts over each whole text fail it outright or become a transformed statistic vector. Per
language and source, minimum-covariance-determinant estimates of location and scatter are
found by concentration steps, and vectors far away by Mahalanobis distance are rejected."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerroutes.llm import _words
from layerroutes.llm._shared import Tables

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: 0.9999 quantile and median of chi-square with 5 degrees of freedom.
CUT, MEDIAN = 25.745, 4.351
#: Least standard deviation of each dimension, so that a group without spread in one still
#: keeps what differs from it by little: a word length longer by 16 %, three signs in the
#: shortest text that the base rules pass (50 words), and a tenth of lines, words or letters.
FLOORS = (0.15, float(np.log1p(3 / 50)), 0.1, 0.1, 0.1)
_DIMS = len(FLOORS)
_STEP = 256  # quantiles are read from counts on a grid of 1 / 256


def _count(column: pa.Array) -> list[np.ndarray]:
    """COUNTS, then lines with a word, upper-case letters and ASCII letters of each text."""
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    data, at = _words.buffers(column)
    parts = []
    for lo, hi in _words.chunks(at):
        d, o = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        h, first, _, _ = _words.numbers(d, o, lower=False)
        raw = d.tobytes()

        def total(mask, o=o):
            c = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=c[1:])
            return c[o[1:]] - c[o[:-1]]

        letters = total(~_words.SPACE[d] & ((d & 0xC0) != 0x80))
        upper = total((d >= 65) & (d <= 90))
        ascii_ = upper + total((d >= 97) & (d <= 122))
        repeat, dup, lines = (np.zeros(hi - lo, np.int64) for _ in range(3))
        for k in range(hi - lo):
            w = h[first[k] : first[k + 1]]
            if len(w) > 3:
                _, inv, c = np.unique(_words.windows(w, 3), return_inverse=True, return_counts=True)
                twice = np.flatnonzero(c[inv] > 1)
                if len(twice):
                    covered = np.zeros(len(w), bool)
                    covered[twice] = covered[twice + 1] = covered[twice + 2] = True
                    repeat[k] = covered.sum()
            found = [x for x in raw[o[k] : o[k + 1]].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            lines[k], dup[k] = len(found), len(found) - len(set(found))
        parts.append([np.diff(first), letters, total(is_symbol[d]), dup, repeat, lines, upper, ascii_])
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(8)]


def statistics(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """_id, the columns ``keep`` and the counts of each text."""
    kinds = [docs.schema[id_col].dataType, *(docs.schema[c].dataType for c in keep)]
    names = ["_id", *(f"_keep_{c}" for c in keep)]
    counts = [*COUNTS, "n_lines", "n_upper", "n_ascii"]

    def run(batches):
        for b in batches:
            made = _count(_words.binary(b.column(len(names))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c, pa.int64()) for c in made)], [*names, *counts])

    chosen = docs.select(*(F.col(c).alias(n) for c, n in zip((id_col, *keep), names, strict=True)), F.col(text_col).cast("string").alias("_text"))
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)] + [T.StructField(c, T.LongType()) for c in counts]
    return chosen.mapInArrow(run, T.StructType(fields))


def _vector() -> list[Column]:
    """Mean word length, symbols a word, repeated lines, repeated words, upper case: on scales
    on which ordinary text lies near one place and a few odd words move little."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(1 + F.col("word_chars") / w),
        F.log(1 + F.col("n_symbols") / w),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / w,
        (F.col("n_upper") + 0.0) / F.greatest(F.col("n_ascii"), F.lit(1)),
    ]


def _quantile(rows: DataFrame, keys: list[str], value: Column, share: float | None) -> DataFrame:
    """Per key the least grid value with at least ``share`` of the rows, or without one more
    than half of them, at or below it. Rows are counted on the grid first, so that a key of any
    size is a few thousand rows."""
    grid = rows.select(*keys, F.floor(value * _STEP).cast("long").alias("g")).groupBy(*keys, "g").agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    run = grid.withColumn("run", F.sum("c").over(by.orderBy("g"))).withColumn("all", F.sum("c").over(by))
    need = F.floor(F.col("all") / 2) + 1 if share is None else F.col("all") * share
    return run.where(F.col("run") >= need).groupBy(*keys).agg(((F.min("g") + 1) / _STEP).alias("at"))


def _shortest_half(frames):
    """Middle and half the width of the shortest range of grid cells with over half the rows."""
    for f in frames:
        at, width = [], []
        for cells in f["cells"]:
            g = np.array([r["g"] for r in cells])
            c = np.cumsum([r["c"] for r in cells])
            before = np.concatenate([[0], c[:-1]])
            end = np.searchsorted(c, before + c[-1] // 2 + 1)
            first = np.flatnonzero(end < len(g))
            k = first[np.argmin(g[end[first]] - g[first])]
            at.append((g[k] + g[end[k]] + 1) / 2 / _STEP)
            width.append((g[end[k]] - g[k] + 1) / 2 / _STEP)
        yield pd.DataFrame({"key": f["key"], "k": f["k"], "mode": at, "width": width})


def _full(q) -> np.ndarray:
    full = np.zeros((_DIMS, _DIMS))
    full[np.tril_indices(_DIMS)] = np.asarray(q, float)
    return full + np.tril(full, -1).T


def _shape(key, start: int, centre: np.ndarray, scatter: np.ndarray) -> tuple:
    """Whitening rows (inverse Cholesky factor, row by row) and the log of the determinant."""
    low = np.linalg.cholesky(scatter)
    return key, start, centre.tolist(), np.linalg.inv(low).ravel().tolist(), float(2 * np.log(np.diag(low)).sum())


_SHAPE = "key string, start int, centre array<double>, white array<double>, logdet double"


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["key", "start", "centre", "white", "logdet"])


def _starts(frames):
    """Four starts a key: medians, shortest halves, and about the medians the scatter of
    hyperbolic tangents and of directions."""
    for f in frames:
        out = []
        for key, p, n, ts, tq, uq in zip(f["key"], f["p"], f["n"], f["ts"], f["tq"], f["uq"], strict=True):
            at, mode = (np.array([r[c] for r in p]) for c in ("at", "mode"))
            sd = np.maximum([1.4826 * r["mad"] for r in p], FLOORS)
            width = np.maximum([1.4826 * r["width"] for r in p], FLOORS)
            mean = np.asarray(ts) / n
            eye = 0.01 * np.eye(_DIMS)
            turned = [_full(tq) / n - np.outer(mean, mean) + eye, _full(uq) / n + eye]
            out += [_shape(key, 0, at, np.diag(sd**2)), _shape(key, 1, mode, np.diag(width**2))]
            out += [_shape(key, 2 + k, at, m * np.outer(sd, sd)) for k, m in enumerate(turned)]
        yield _frame(out)


def _shapes(frames):
    """From sums to centre and scatter. A scatter leans on that of the level above by a weight
    that falls smoothly with its rows: at as many rows as a scatter has entries, by half."""
    entries = _DIMS * (_DIMS + 1) / 2
    for f in frames:
        out = []
        for r in f.to_dict("records"):
            scatter = None
            for u in ("2", "1", "0"):  # all, language, own
                if r[f"s{u}"] is None:
                    continue
                n = r[f"n{u}"]
                mean = np.asarray(r[f"s{u}"]) / n
                own = _full(r[f"q{u}"]) / n - np.outer(mean, mean) + np.diag(np.square(FLOORS))
                w = 1.0 if scatter is None else n / (n + entries)
                scatter = own if scatter is None else w * own + (1 - w) * scatter
            out.append(_shape(r["key"], r["start"], mean, scatter))
        yield _frame(out)


def _estimates(near: DataFrame, tree: DataFrame) -> DataFrame:
    """Counts, sums and products by key and start of the rows ``near``."""
    xs = [f"x{k}" for k in range(_DIMS)]
    cross = [F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(_DIMS) for j in range(i + 1)]
    return near.groupBy("key", "start").agg(F.count("*").alias("n"), F.array(*(F.sum(x) for x in xs)).alias("s"), F.array(*cross).alias("q")).join(tree, "key")


def _fit(sums: DataFrame) -> DataFrame:
    def of(level: str) -> DataFrame:
        return sums.select(F.col("key").alias(f"up{level}"), "start", *(F.col(c).alias(c + level) for c in "nsq"))

    own = sums.select("key", "start", "up1", "up2", *(F.col(c).alias(c + "0") for c in "nsq"))
    own = own.join(of("1"), ["up1", "start"], "left").join(of("2"), ["up2", "start"], "left")
    return own.select("key", "start", *(f"{c}{u}" for u in "012" for c in "nsq")).mapInPandas(_shapes, _SHAPE)


def _distance() -> Column:
    x = [F.col(f"x{k}") - F.col("centre")[k] for k in range(_DIMS)]
    total = F.lit(0.0)
    for i in range(_DIMS):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col("white")[i * _DIMS + j] * x[j]
        total = total + y * y
    return total


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reweights: int = 3, least: int = _DIMS + 1, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Per row of ``docs``: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and distance (squared, null if base_failed).

    base_failed: fewer than ``min_words`` words, or over ``max_repeat`` percent of the words in
    three-word windows that occur twice or more in the text. The others are judged against
    the estimates of their language and source if these have ``least`` rows to learn from, else
    of their language, else of all; scatters of few rows lean on the level above. Null and empty
    texts have counts of 0 and fail. Null
    languages and sources form groups of their own. Null ids, ties and repeated rows are
    rows like any other; columns with other names are ignored. With too few rows for any
    estimate all that pass the base rules are kept. An empty table gives an empty result.

    Up to half of a group may be junk: four deterministic starts take two concentration steps
    over just more than half of the rows, the two of less determinant go on until it falls no
    more, the least wins, and it is estimated again, ``reweights`` times, from all rows that it does
    not reject.

    One pass over the texts; then only counts move. Each concentration step is two aggregates
    with map-side combine over all rows, however large a source is."""
    t = Tables(docs.sparkSession, "quality_rules")
    stats = t.store(statistics(docs, id_col, text_col, (lang_col, source_col)), "counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    lang, source = (F.to_json(F.struct(F.col(f"_keep_{c}").alias("v"))) for c in (lang_col, source_col))
    rows = stats.withColumn("base_failed", failed)
    rows = rows.withColumns({f"x{k}": v for k, v in enumerate(_vector())} | {"k0": F.concat_ws("\x1f", lang, source), "k1": lang, "k2": F.lit("*")})
    xs = [f"x{k}" for k in range(_DIMS)]
    good = rows.where("not base_failed")

    size = t.store(good.groupBy("k0", "k1").agg(F.count("*").alias("n")), "sizes")
    n1 = size.groupBy("k1").agg(F.sum("n").alias("n1"))
    n2 = size.agg(F.sum("n").alias("n2"))
    small = F.broadcast(n2)  # one row
    level = size.join(n1, "k1").join(small)
    used = F.when(F.col("n") >= least, F.col("k0")).when(F.col("n1") >= least, F.col("k1")).when(F.col("n2") >= least, F.lit("*"))
    level = t.store(level.select("k0", "k1", used.alias("key"), "n", "n1", "n2"), "levels")
    none = F.lit(None).cast("string")
    tree = level.where(F.col("n") >= least).select(F.col("k0").alias("key"), F.col("k1").alias("up1"), F.lit("*").alias("up2"))
    tree = tree.union(level.where(F.col("n1") >= least).select("k1", none, F.lit("*")).distinct())
    tree = t.store(tree.union(level.where(F.col("n2") >= least).select(F.lit("*"), none, none).distinct()), "tree")

    # a row helps to estimate every group it lies in
    each = good.select(*xs, F.explode(F.array("k0", "k1", "k2")).alias("key"))
    each = t.store(each.join(tree.select("key"), "key"), "vectors")
    dims = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(x).alias("v")) for k, x in enumerate(xs)))).alias("d")
    long = each.select("key", dims).select("key", F.col("d.k").alias("k"), F.col("d.v").alias("v"))
    mid = t.store(_quantile(long, ["key", "k"], F.col("v"), 0.5), "medians")
    away = _quantile(long.join(mid, ["key", "k"]), ["key", "k"], F.abs(F.col("v") - F.col("at")), 0.5).withColumnRenamed("at", "mad")
    cells = long.groupBy("key", "k", F.floor(F.col("v") * _STEP).cast("long").alias("g")).agg(F.count("*").alias("c"))
    cells = cells.groupBy("key", "k").agg(F.sort_array(F.collect_list(F.struct("g", "c"))).alias("cells"))  # a few thousand entries
    modes = cells.mapInPandas(_shortest_half, "key string, k int, mode double, width double")
    both = mid.join(away, ["key", "k"]).join(modes, ["key", "k"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "at", "mad", "mode", "width"))).alias("p"))  # _DIMS entries
    both = t.store(both, "places")
    z = [(F.col(xs[k]) - F.col("p")[k]["at"]) / F.greatest(1.4826 * F.col("p")[k]["mad"], F.lit(FLOORS[k])) for k in range(_DIMS)]
    turned = each.join(both.select("key", "p"), "key").select("key", *(v.alias(f"z{k}") for k, v in enumerate(z)))
    zs = [F.col(f"z{k}") for k in range(_DIMS)]
    norm2 = F.greatest(sum((v * v for v in zs), F.lit(0.0)), F.lit(1e-12))
    pairs = [(i, j) for i in range(_DIMS) for j in range(i + 1)]
    turned = turned.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.sum(F.tanh(v)) for v in zs)).alias("ts"), F.array(*(F.sum(F.tanh(zs[i]) * F.tanh(zs[j])) for i, j in pairs)).alias("tq"), F.array(*(F.sum(zs[i] * zs[j] / norm2) for i, j in pairs)).alias("uq"))
    first = t.store(both.join(turned, "key").mapInPandas(_starts, _SHAPE), "starts")

    log_d = F.log1p(F.col("d2"))

    def nearest(now: DataFrame) -> DataFrame:
        far = each.join(now, "key").select("key", "start", *xs, _distance().alias("d2"))
        return far.join(_quantile(far, ["key", "start"], log_d, None), ["key", "start"]).where(log_d <= F.col("at"))

    shapes = ("centre", "white", "logdet")
    now, sums, best, k, pair = first, None, None, 0, ["key", "start"]
    while k == 0 or not now.isEmpty():  # until no determinant falls any more; the least so far is kept
        new = t.store(_estimates(nearest(now), tree), "sums")
        sums = new if sums is None else t.store(sums.join(new.select(pair), pair, "left_anti").unionByName(new), "sums")
        shape = t.store(_fit(sums), "shape")
        k += 1
        if best is None:
            best = now = shape
            continue
        new = shape.select("key", "start", *(F.col(c).alias(f"new_{c}") for c in shapes))
        less = F.col("new_logdet") < F.col("logdet") - 1e-3
        best = t.store(best.join(new, pair).select("key", "start", *(F.when(less, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in shapes), less.alias("moved")), "best")
        if k == 2:  # the two better starts go on
            place = F.row_number().over(Window.partitionBy("key").orderBy("logdet", "start"))  # four rows a key
            best = t.store(best.withColumn("place", place).where("place <= 2").drop("place"), "best")
        now = t.store(shape.join(best.where("moved").select(pair), pair, "left_semi"), "moved")
    best = best.groupBy("key").agg(F.min_by(F.struct("start", "centre", "white"), F.struct("logdet", "start")).alias("b")).select("key", "b.*")

    def scaled(shape: DataFrame, inside: DataFrame) -> DataFrame:
        scale = _quantile(inside, ["key"], log_d, 0.5).select("key", F.greatest(F.expm1("at") / MEDIAN, F.lit(1.0)).alias("scale"))
        return t.store(shape.join(scale, "key").select("key", "centre", "white", "scale"), "scaled")

    fit = scaled(best, each.join(best, "key").select("key", _distance().alias("d2")))
    for _ in range(reweights):  # again from all rows that are not rejected
        inside = each.join(fit, "key").where(_distance() <= CUT * F.col("scale")).select("key", F.lit(0).alias("start"), *xs)
        shape = t.store(_fit(t.store(_estimates(inside, tree), "sums")), "shape")
        fit = scaled(shape, inside.drop("start").join(shape, "key").select("key", _distance().alias("d2")))
    final = t.store(level.select("k0", "key").join(fit, "key").drop("key"), "verdicts")

    out = rows.join(final, "k0", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return out.select(F.col("_id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), "distance")
