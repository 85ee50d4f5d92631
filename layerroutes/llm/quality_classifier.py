"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is cut into
pieces, each piece is compressed with both, and the normalised difference of the summed sizes
(bad - good) / (bad + good) becomes a probability by logistic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerroutes.llm import _words

PIECE = 2048


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    piece: int = PIECE


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Sizes:
    def __init__(self, good: bytes, bad: bytes, piece: int):
        import zstandard

        self.piece, self.tools = piece, []
        for raw in (good, bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=3)
            params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.tools.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))

    def difference(self, text: bytes) -> float:
        good = bad = 0
        a, b = self.tools[0].compress, self.tools[1].compress
        for k in range(0, len(text), self.piece):
            x = text[k : k + self.piece]
            good += len(a(x))
            bad += len(b(x))
        return (bad - good) / (bad + good) if good else 0.0


_kept: dict[tuple, _Sizes] = {}


def _sizes(good: bytes, bad: bytes, piece: int) -> _Sizes:
    key = (hash(good), hash(bad), len(good), len(bad), piece)
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Sizes(good, bad, piece)
    return _kept[key]


def _differences(docs: DataFrame, text_col: str, good: bytes, bad: bytes, piece: int) -> DataFrame:
    """``docs`` with its text replaced by the column _diff."""
    sent = docs.sparkSession.sparkContext.broadcast((good, bad))  # two dictionaries of fixed size
    others = [f for f in docs.schema.fields if f.name != text_col]
    at = docs.columns.index(text_col)

    def run(batches):
        sizes = _sizes(*sent.value, piece)
        for b in batches:
            column = _words.binary(b.column(at))
            d = [sizes.difference(x.as_py()) for x in column]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), pa.array(d, pa.float64())], [*(f.name for f in others), "_diff"])

    return docs.mapInArrow(run, T.StructType([*others, T.StructField("_diff", T.DoubleType())]))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve by Newton steps, with a little
    shrinkage of the standardised slope."""
    mean, sd = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w, ridge = np.zeros(2), np.array([1.0, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(0.0, w[0]) / sd
    return float(slope), float(w[1] - slope * mean)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, pieces_each: int = 8, dict_bytes: int = 112_640, piece: int = PIECE) -> Model:
    """A model of a bounded sample: of each class at most ``per_class`` labelled texts, first
    in the order of a hash of their ids, at most ``pieces_each`` pieces of each for the
    dictionaries. Two thirds of the sample build the dictionaries, the rest calibrates them.
    Rows of the held-out third of ids, and null labels, are never learnt from."""
    train = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"))
    order = F.xxhash64(F.lit("quality"), F.col(id_col).cast("string"))
    picked = [train.where(F.col("y") == y).orderBy(order, id_col).limit(per_class) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).select(F.col(id_col).alias("_id"), F.col("y").cast("int").alias("y"), (F.pmod(order, F.lit(3)) == 0).alias("check"))
    picked = F.broadcast(picked)  # two times per_class rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(picked, "_id").select("y", "check", "_text")

    def cut(batches):
        for b in batches:
            y, out = [], []
            for label, text in zip(b.column(0).to_pylist(), _words.binary(b.column(2)).to_pylist(), strict=True):
                n = -(-len(text) // piece)
                for k in sorted({i * n // min(n, pieces_each) for i in range(min(n, pieces_each))}) if n else ():
                    y.append(label)
                    out.append(text[k * piece : (k + 1) * piece])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.binary())], ["y", "piece"])

    samples = {0: set(), 1: set()}
    for r in rows.where("not check").mapInArrow(cut, "y int, piece binary").toLocalIterator():
        samples[r.y].add(bytes(r.piece))
    good, bad = (_dictionary(sorted(samples[k]), dict_bytes) for k in (1, 0))
    got = _differences(rows.where("check").select("y", "_text"), "_text", good, bad, piece).toPandas()
    if got["y"].nunique() < 2:
        share = float(got["y"].mean()) if len(got) else 0.5
        return Model(good, bad, 0.0, float(np.log((share + 0.01) / (1.01 - share))), piece)
    slope, intercept = _calibrate(got["_diff"].to_numpy(), got["y"].to_numpy(float))
    return Model(good, bad, slope, intercept, piece)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return b"".join(samples)[:size] or b" " * 8


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Per row of ``docs``: id_col, held_out, score (0 to 1, higher: good likelier), predicted
    (1 if score >= 0.5) and the columns ``keep``; ``prefix`` goes before held_out, score and
    predicted, for columns to keep that are called the same.

    The score depends on the whole text only. Null and empty texts get the score of no
    difference. A null id is not held out. Repeated rows are scored alike; other columns are
    ignored. An empty table gives an empty result. No shuffle: one pass."""
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    out = _differences(chosen, "_text", model.good, model.bad, model.piece)
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("_diff") + F.lit(model.intercept))))
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias(prefix + "held_out"), p.alias(prefix + "score"), (p >= 0.5).cast("int").alias(prefix + "predicted"), *(F.col(f"_keep_{c}").alias(c) for c in keep))
