"""Whitening components by shifted CholeskyQR.

Rows are centred exactly, in integers. A pass solves all triangular factors found so far for
each centred row and sums the Gram matrix of the results; its Cholesky factor is the next
factor. The first pass, and any whose Gram matrix is singular in floating point, adds a small
multiple of the identity. Once the rows are orthonormal the factors multiply to R, and the
singular values and right vectors of R are those of the centred rows: nothing is squared, so
small components keep their digits."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerroutes.llm._shared import Tables

SLICE = 1 << 20  # numbers worked on at once
PASSES = 6
LIMIT = 2**62
_LIMB = 21


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Centre:
    """n and the sums S of a fit list; exact differences n * x - S."""

    def __init__(self, n: int, sums: list[int], top: int):
        self.n, self.sums = n, sums
        self.wide = 2 * n * max(top, 1) >= LIMIT

    def apart(self, x: np.ndarray) -> np.ndarray:
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.apart(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of squares of the differences, as Python integers."""
        d = self.apart(x)
        if self.wide:
            return list((d * d).sum(axis=1))
        d = np.abs(d)
        if d.size and float(d.max()) ** 2 * d.shape[1] < LIMIT:
            return (d * d).sum(axis=1).tolist()
        mask = np.int64((1 << _LIMB) - 1)
        limbs = [(d >> np.int64(_LIMB * k)) & mask for k in range(3)]
        total = np.zeros(len(d), dtype=object)
        for i in range(3):
            for j in range(3):
                total += np.einsum("rd,rd->r", limbs[i], limbs[j]).astype(object) * (1 << _LIMB * (i + j))
        return total.tolist()


def solved(rows: np.ndarray, r: np.ndarray, block: int = 64) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, block by block of columns."""
    q = np.empty_like(rows)
    for a in range(0, len(r), block):
        b = min(a + block, len(r))
        q[:, a:b] = np.linalg.solve(r[a:b, a:b].T, (rows[:, a:b] - q[:, :a] @ r[:a, a:b]).T).T
    return q


def _slices(batches: Iterator[pa.RecordBatch], width: int, column: str = "x") -> Iterator[np.ndarray]:
    step = max(1, SLICE // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield _matrix(batch.slice(at, step).column(column), width)


def _sums(fit: DataFrame, width: int) -> Centre:
    """n, exact sums and the greatest size of an entry: one pass, a row per dimension and task."""

    def part(batches):
        n, top, high, low = 0, 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _slices(batches, width):
            n, top = n + len(x), max(top, int(np.abs(x).max(initial=0)))
            high += (x >> np.int64(32)).sum(axis=0)
            low += (x & np.int64(0xFFFFFFFF)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(width), "n": [n] * width, "top": [top] * width, "high": high, "low": low})

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    got = fit.mapInArrow(part, "i long, n long, top long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.max("top").alias("top"), wide("high"), wide("low")).orderBy("i").collect()
    return Centre(got[0].n, [int(g.high) * 2**32 + int(g.low) for g in got], max(g.top for g in got))


def gram(fit: DataFrame, width: int, size: int, made) -> np.ndarray:
    """Sum of yᵀy over the rows y of ``made(x)`` for the blocks x of ``fit``: one ``size`` by
    ``size`` matrix a task, whose rows meet by number and are summed as they arrive."""
    names = ["i", "row"]

    def part(batches):
        g = np.zeros((size, size))
        for x in _slices(batches, width):
            y = made(x)
            g += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(g), pa.list_(pa.float64()))], names=names)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), _matrix(batch.column("row"), size)):
                total[i] = total[i] + row if i in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], names=names)

    schema = "i long, row array<double>"
    parts = fit.coalesce(4 * fit.sparkSession.sparkContext.defaultParallelism).mapInArrow(part, schema)
    got = parts.repartition("i").mapInArrow(add, schema).collect()
    out = np.zeros((size, size))
    for g in got:
        out[g.i] += g.row
    return (out + out.T) / 2


def components(fit: DataFrame, width: int, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) of the covariance of ``fit`` (x)."""
    eps, factors, r = np.finfo(float).eps, [], np.eye(width)

    def made(x: np.ndarray) -> np.ndarray:
        y = centre.rows(x)
        for f in factors:
            y = solved(y, f)
        return y

    for step in range(PASSES):
        g = gram(fit, width, width, made)
        seen = np.linalg.eigvalsh(g)
        lost = 64 * width * eps * max(seen[-1], 0)
        if seen[-1] <= 0:
            return np.zeros(width), np.eye(width)
        if step and (np.all((seen <= lost) | (abs(seen - 1) < 0.5)) and (abs(g - np.eye(width)).max() < 1e-12 * width or seen[0] <= lost or step == PASSES - 1)):
            break
        shift = 0.0 if step and seen[0] > lost else min(11 * (centre.n * width + width * (width + 1)) * eps / 2, 1e-6) * seen[-1]
        factors = [*factors, np.linalg.cholesky(g + shift * np.eye(width)).T]
        r = factors[-1] @ r
    # the last factor, which a singular Gram matrix has too
    w, u = np.linalg.eigh(g)
    r = (np.sqrt(np.clip(w, 0, None))[:, None] * u.T) @ r
    _, s, vt = np.linalg.svd(r)
    s = np.where(s > 8 * width * eps * s[0], s, 0.0)
    v = vt.T
    v = v * np.where(v[abs(v).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    return s * s / centre.n, v


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """Per remaining row of ``vectors`` and component up to ``top``: id_col, component (from 1),
    n (vectors of the fit list), deviation decimal(38,0), whitened, explained, identity_error.

    An entry c becomes x = floor(scale * c) + offset, and at most 2**62 in size. Rows go whose
    vector is null or holds null or non-finite entries, and those of another length than most
    (of lengths equally frequent, the greatest stays). The fit list is each distinct x vector
    once, so repeated rows weigh nothing, but each gets its result. Null ids are kept. A table
    without rows, or whose vectors are empty, gives an empty result. Components are at most the
    dimensions; one without variance has explained 0 and whitened null, and where no component
    has variance (one distinct vector), explained and identity_error are null. Equal eigenvalues
    come in any order. A deviation beyond 38 digits is null. Other columns are ignored.

    Partitioning: vectors are shuffled once, for the distinct list, equal ones combined before,
    and the list is stored. A pass reads it in order and moves one dimensions-squared matrix a
    task; the driver holds one such matrix. ``n``, sums and deviations are exact integers."""
    t = Tables(vectors.sparkSession, "whitening")
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    code = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-(2.0**61))), F.lit(2.0**61))) + F.lit(offset)
    rows = vectors.where(v.isNotNull() & fine).select(F.col(id_col).alias("id"), F.transform(v, code).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = sizes.width if sizes else 0
    rows = rows.where(F.size("x") == width)
    top = min(top, width)
    kind = rows.schema["id"].dataType.simpleString()
    if not width:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")

    fit = t.store(rows.select("x").distinct(), "fit", "zstd")
    centre = _sums(fit, width)
    values, vectors_ = components(fit, width, centre)
    live = int((values[:top] > 0).sum())
    onto = vectors_[:, :live] / np.sqrt(values[:live])
    trace = float(values.sum())
    error = None
    if live:
        error = float(abs(gram(fit, width, live, lambda x: centre.rows(x) @ onto) / centre.n - np.eye(live)).max())
    explained = [float(e) / trace if trace > 0 else None for e in values[:top]]

    def project(batches):
        step = max(1, SLICE // width)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _matrix(batch.column("x"), width)
                y = (centre.rows(x) @ onto).tolist()
                none = [None] * (top - live)
                far = [Decimal(d) if d < 10**38 else None for d in centre.deviation(x)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(far, pa.decimal128(38, 0)), pa.array([r + none for r in y], pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    done = rows.mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    each = done.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(e).cast("double") for e in explained)), F.col("at") + 1)
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
