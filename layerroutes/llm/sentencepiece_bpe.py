"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one per character, and an agenda of adjacent pairs ordered by the
score of the piece they make joins them (``_merges``). In these vocabularies no piece has a
space after another character, so that stretches of spaces and what follows them are encoded
on their own; each distinct stretch of an Arrow batch is encoded once, checked against the
sentencepiece library, and kept for later batches."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerroutes.llm import _words
from layerroutes.llm._merges import LONGEST_ROW, ROWS, Merges

SPACE = "▁"
MODEL_LIMIT = 64 << 20
KEPT = 600_000  # stretches that a worker keeps
_STRETCH = re.compile(rb" *[^ ]+| +")


class Encoder:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        usual = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p, u in zip(pieces, usual, strict=True) if u):
            raise ValueError("a piece holds a space after another character; such vocabularies can't be cut at spaces")
        self.ids = ids = {p: i for i, p in enumerate(pieces) if usual[i]}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        left, right, score, made = [], [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                    left.append(a), right.append(b), made.append(i), score.append(sp.get_score(i))
        places = np.unique(-np.asarray(score), return_inverse=True)[1]
        self.merges = Merges(left, right, places, made)
        # characters without a piece keep their place as symbols that nothing merges with
        self.symbol = np.arange(0x110000, dtype=np.int64) + 2**31
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.symbol[ord(SPACE)]
        self.decimal = [b",%d" % i for i in range(n)]
        self.seen: dict[bytes, tuple[bytes, bytes]] = {}

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def spelled(self, symbols: list[int]) -> list[int]:
        """Ids, with a character that has no piece as its bytes."""
        out: list[int] = []
        for s in symbols:
            if s < 2**31:
                out.append(s)
            else:
                out += [self.byte[b] for b in chr(s - 2**31).encode()]
        return out

    def encoded(self, texts: list[str]) -> list[list[int]]:
        found: list = [None] * len(texts)
        by_size: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            by_size.setdefault(len(t), []).append(k)
        for n, which in by_size.items():
            if n > LONGEST_ROW:
                for k in which:
                    found[k] = self.spelled(self.merges.alone(self.symbols(texts[k])).tolist())
                continue
            for a in range(0, len(which), ROWS):
                part = which[a : a + ROWS]
                made = self.merges.matrix(self.symbols("".join([texts[k] for k in part])).reshape(-1, n))
                odd = (made >= 2**31).any(1).tolist()
                for k, row, m, o in zip(part, made.tolist(), (made >= 0).sum(1).tolist(), odd, strict=True):
                    found[k] = self.spelled(row[:m]) if o else row[:m]
        return found

    def learn(self, stretches: list[bytes], check: bool) -> None:
        texts = [s.decode() for s in stretches]
        found = self.encoded(texts)
        if check:
            # the library puts a space before each text, which every stretch brings along
            theirs = self.library.encode([t[1:] for t in texts], num_threads=1)
            for t, a, b in zip(texts, found, theirs, strict=True):
                if a != b and t != " ":
                    raise ValueError(f"not as the sentencepiece library encodes: {t!r}")
        raw, decimal = self.raw.__getitem__, self.decimal.__getitem__
        for s, i in zip(stretches, found, strict=True):
            self.seen[s] = (b"".join(map(decimal, i)), b"".join(map(raw, i)))

    def batch(self, texts: list[bytes], check: bool) -> list[tuple[bytes, bytes]]:
        """Decimal ids, each after a comma, and decoded bytes of each text."""
        cut = []
        for t in texts:
            t = t.replace(SPACE.encode(), b" ")
            if not t:
                cut.append([])
            elif b"  " in t or t[0] == 32 or t[-1] == 32:
                cut.append(_STRETCH.findall(b" " + t))
            else:
                cut.append([b" " + w for w in t.split(b" ")])
        new = set().union(*cut) - self.seen.keys()
        if len(self.seen) + len(new) > KEPT:
            self.seen.clear()
            new = set().union(*cut)
        self.learn(list(new), check)
        out = []
        for stretches in cut:
            both = [self.seen[s] for s in stretches]
            out.append((b"".join([x[0] for x in both]), b"".join([x[1] for x in both])[1:]))
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256 (of the text that the ids decode to); ``with_ids`` adds ids array<int>
    and decoded string.

    Null and empty texts have no ids. Ids of any kind, null ids, ties and repeated rows go
    through row by row; other columns are ignored. An empty table gives an empty result. The
    model's bytes, at most 64 MB, go to each executor once. ``check`` compares each distinct
    stretch with the library and fails on a difference.

    No shuffle: one pass, in chunks of about a megabyte, with a bounded table of stretches."""
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > MODEL_LIMIT:
        raise ValueError("the model is over 64 MB")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches):
        encoder = _encoder(sent.value)
        for b in batches:
            column = _words.binary(b.column(1))
            _, at = _words.buffers(column)
            n, ids, decoded, plain = [], [], [], ([], [])
            for lo, hi in _words.chunks(at):
                for i, d in encoder.batch(column.slice(lo, hi - lo).to_pylist(), check):
                    n.append(i.count(b","))
                    ids.append(hashlib.sha256(i[1:]).hexdigest())
                    # bytes that are no UTF-8 decode to U+FFFD; texts that were encoded have none
                    decoded.append(hashlib.sha256(d).hexdigest())
                    if with_ids:
                        plain[0].append([int(x) for x in i[1:].split(b",") if x])
                        plain[1].append(d.decode(errors="replace"))
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                arrays += [pa.array(plain[0], pa.list_(pa.int32())), pa.array(plain[1], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType(fields))
    return out.withColumnRenamed("id", id_col)
