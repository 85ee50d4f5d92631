"""Packing of token sequences by shortest-pack-first over the histogram of lengths.

Documents are cut into full sequences and a rest. Over the histogram of rests, at most one
entry per length, lengths are placed longest first, each into the pack with the most room.
As many packs are opened as the tokens need; a length that then fits nowhere is cut at the
room of the shortest pack and its remainder is placed again in its turn. The result is a list
of slots (which ranks of which length go where), joined back to the documents by rank."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerroutes.llm import _words
from layerroutes.llm._merges import LONGEST_ROW, ROWS, Merges
from layerroutes.llm._shared import Tables

FILE_LIMIT = 64 << 20
HELD = 12 << 20  # bytes of encoded parts in one generation of a worker's table
#: Contractions that are parts of their own.
_SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_SPACE_, _OTHER, _LETTER, _DIGIT = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By two-byte UTF-8 character below U+0180: lower case, class, and is its lower case,
    class or normal form not alike in every Unicode version. The index is the last 14 bits of
    its two bytes; bytes below 128 stand for themselves."""
    lower, kind, odd = np.zeros(1 << 14, np.uint16), np.full(1 << 14, _OTHER, np.uint8), np.ones(1 << 14, bool)
    for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x130), *range(0x131, 0x180)]:
        low = chr(c).lower()
        at, code = (int.from_bytes(x.encode(), "big") for x in (chr(c), low))
        k = at & 0x3FFF if c > 127 else at
        lower[k], odd[k] = code, False
        kind[k] = _SPACE_ if low.isspace() else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(low)[0], _OTHER)
    return lower, kind, odd


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it
    is, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Known:
    """Encoded parts by their number: bytes and ids, in arrays sorted by number."""

    def __init__(self, kind: np.dtype):
        self.key, self.raw_at, self.id_at = np.empty(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.raw, self.ids = np.empty(0, np.uint8), np.empty(0, kind)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.key, self.raw_at, self.id_at, self.raw, self.ids))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each number, or -1."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def with_(self, key: np.ndarray, raw: np.ndarray, raw_n: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> _Known:
        """This table and more parts; numbers must differ."""
        out = _Known(ids.dtype)
        keys = np.concatenate([self.key, key])
        order = np.argsort(keys, kind="stable")
        out.key = keys[order]
        out.raw, out.raw_at = _rows(np.concatenate([self.raw, raw]), np.concatenate([np.diff(self.raw_at), raw_n]), order)
        out.ids, out.id_at = _rows(np.concatenate([self.ids, ids]), np.concatenate([np.diff(self.id_at), ids_n]), order)
        return out


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at, at + 1, ..., at + n - 1 for each entry, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _rows(flat: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of lengths n in ``flat``, taken in ``order``, and their new bounds."""
    at = np.concatenate([[0], np.cumsum(n)])
    return flat[_spread(at[:-1][order], n[order])], np.concatenate([[0], np.cumsum(n[order])])


class WordTokenizer:
    """Ids of a tokenizers file with lower case, word ends and byte-level merges.

    Texts are taken as bytes of a whole batch: lower case, then parts (letters, single digits,
    other signs, contractions). Parts are looked up by number and compared byte by byte; new
    ones are merged as matrices. Encoded parts are kept in two generations of bounded size.
    Texts with unusual characters go to the library."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        model = json.loads(text)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs])
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.kind = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
        self.lower, self.char, self.odd = _tables()
        self.forget()

    def forget(self) -> None:
        self.fresh, self.young, self.old = (_Known(self.kind) for _ in range(3))

    def _prepared(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case bytes, the class of each (of its character), is it the first byte of its
        character, and which texts are odd."""
        wide = np.flatnonzero(data >= 0xC0)  # first bytes of longer characters
        one = np.minimum(data, 127)
        bad = np.flatnonzero(self.odd[one] & (data < 128))
        out, kind = self.lower[one].astype(np.uint8), self.char[one]
        first = np.ones(len(data), bool)
        if len(wide):
            two = (data[wide].astype(np.int64) << 8 | data[np.minimum(wide + 1, len(data) - 1)]) & 0x3FFF
            strange = (data[wide] > 0xC5) | self.odd[two]
            bad = np.concatenate([bad, wide[strange]])
            wide, two = wide[~strange], two[~strange]
            out[wide], out[wide + 1] = self.lower[two] >> 8, self.lower[two] & 255
            kind[wide] = kind[wide + 1] = self.char[two]
            first[wide + 1] = False
        marks = np.flatnonzero(data[:-1] == 60)
        bad = np.concatenate([bad, marks[data[marks + 1] == 124]])  # "<|" may begin a special token
        odd = np.zeros(len(at) - 1, bool)
        odd[np.searchsorted(at, bad, side="right") - 1] = True
        return out, kind, first, odd

    @staticmethod
    def _parts(data: np.ndarray, kind: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each part. kind is 0 between parts."""
        begin = np.ones(len(data), bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin[at[:-1][at[:-1] < len(data)]] = True
        begin |= kind == _DIGIT
        begin &= first
        bounds = np.append(data, np.zeros(3, np.uint8))  # no text ends in the middle of a contraction
        for i in np.flatnonzero((data == 39) & begin & (kind == _OTHER)).tolist():
            word = bounds[i : i + 3].tobytes().decode("latin-1")
            n = next((len(x) for x in _SHORT if word.startswith(x)), 0)
            if n and not begin[i + 2 : i + n].any() and at[np.searchsorted(at, i, side="right")] >= i + n:
                begin[i + 1] = False
                if i + n < len(data) and first[i + n]:
                    begin[i + n] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        keep = kind[start] != _SPACE_
        return start[keep], end[keep]

    def _learn(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and how many each has."""
        made, count = [], np.zeros(len(n), np.int64)
        if not len(n):
            return np.empty(0, self.kind), count
        order = np.argsort(n, kind="stable")
        sizes, heads = np.unique(n[order], return_index=True)
        for size, some in zip(sizes.tolist(), np.split(order, heads[1:]), strict=True):
            for a in range(0, len(some), ROWS):
                group = some[a : a + ROWS]
                raw = data[start[group][:, None] + np.arange(size)]
                symbols = self.inner[raw]
                symbols[:, -1] = self.last[raw[:, -1]]
                if size > LONGEST_ROW:
                    rows = [self.merges.alone(s) for s in symbols]
                    count[group] = [len(r) for r in rows]
                    flat = np.concatenate(rows)
                else:
                    ids = self.merges.matrix(symbols)
                    count[group] = (ids >= 0).sum(1)
                    flat = ids[ids >= 0]
                made.append((group, flat.astype(self.kind)))
        groups = np.concatenate([g for g, _ in made])
        flat, _ = _rows(np.concatenate([f for _, f in made]), count[groups], np.argsort(groups))
        return flat, count

    def _ids(self, data: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts with different numbers, how many each has, and which could not be
        told from a known part of the same number."""
        ids_n, clash = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        place, todo = np.full(len(key), -1, np.int64), np.arange(len(key))
        found = []
        for known in (self.fresh, self.young, self.old):
            hit = known.find(key[todo])
            got, hit, todo = todo[hit >= 0], hit[hit >= 0], todo[hit < 0]
            same = np.diff(known.raw_at)[hit] == n[got]
            clash[got[~same]] = True
            got, hit = got[same], hit[same]
            differ = known.raw[_spread(known.raw_at[hit], n[got])] != data[_spread(start[got], n[got])]
            if differ.any():
                clash[np.repeat(got, n[got])[differ]] = True
            size = np.diff(known.id_at)[hit]
            place[got], ids_n[got] = known.id_at[hit], size
            found.append((got, known.ids[_spread(known.id_at[hit], size)]))
        more, ids_n[todo] = self._learn(data, start[todo], n[todo])
        found.append((todo, more))
        order = np.concatenate([g for g, _ in found])
        flat, at = _rows(np.concatenate([f for _, f in found]), ids_n[order], np.argsort(order))
        new = np.union1d(todo, found[2][0][~clash[found[2][0]]])  # old parts that are met again stay
        self.fresh = self.fresh.with_(key[new], data[_spread(start[new], n[new])], n[new], flat[_spread(at[:-1][new], ids_n[new])], ids_n[new])
        if len(self.fresh.key) > 1 << 15:
            f = self.fresh
            self.young = self.young.with_(f.key, f.raw, np.diff(f.raw_at), f.ids, np.diff(f.id_at))
            self.fresh = _Known(self.kind)
            if self.young.nbytes > HELD:
                self.young, self.old = _Known(self.kind), self.young
        return flat, ids_n, clash

    def encode(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The ids of each text and ``end`` after them, as little-endian numbers of ``kind``."""
        if not len(data):
            return [end.tobytes()] * (len(at) - 1)
        low, kind, first, odd = self._prepared(data, at)
        start, stop = self._parts(low, kind, first, at)
        keep = ~odd[np.searchsorted(at, start, side="right") - 1]
        start, stop = start[keep], stop[keep]
        n = stop - start
        key, some, which = np.unique(_words.hashes(low, start, stop, lower=False), return_index=True, return_inverse=True)
        flat, ids_n, clash = self._ids(low, start[some], n[some], key)
        rep = start[some][which]
        apart = n != n[some][which]
        if not apart.any():
            apart = np.zeros(len(n), bool)
            apart[np.repeat(np.arange(len(n)), n)[low[_spread(start, n)] != low[_spread(rep, n)]]] = True
        apart |= clash[which]
        if apart.any():  # two parts of one number
            odd[np.searchsorted(at, start[apart], side="right") - 1] = True
        where = np.concatenate([[0], np.cumsum(ids_n)])[:-1]
        size = ids_n[which]
        ids = flat[_spread(where[which], size)].astype(self.kind)
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, at)].tolist()
        tail, item, raw = end.astype(self.kind).tobytes(), self.kind.itemsize, ids.tobytes()
        out = [raw[a * item : b * item] + tail for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(odd).tolist():
            text = data[at[k] : at[k + 1]].tobytes().decode()
            out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + tail
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        data, at = _words.buffers(_words.binary(pa.array(texts, pa.string())))
        return self.encode(data, at, np.empty(0, self.kind))


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(text: str) -> WordTokenizer:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(text)
    return _tokenizers[key]


def shortest_pack_first(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, start, n, first sequence, offset) and the number
    of packs. Of the rank-th text of a length, tokens start to start + n lie in sequence
    (first sequence + rank - first rank) from offset on."""
    packs = -(-sum(n * c for n, c in histogram.items()) // size)
    bins: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for n, c in histogram.items():
        if not 0 < n <= size:
            raise ValueError("lengths must be 1 to size")
        bins[n].append((n, 0, c, 0))
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first sequence, count)
    heap: list[int] = []
    slots, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room:
            if not rooms[room]:
                heapq.heappush(heap, -room)
            rooms[room].append((first, count))

    for n in range(size, 0, -1):
        while bins[n]:
            length, r0, r1, start = bins[n].pop()
            while heap and not rooms[-heap[0]]:
                heapq.heappop(heap)
            room = -heap[0] if heap else 0
            if room < n and opened < packs:
                k = min(r1 - r0, packs - opened)
                slots.append((length, r0, r0 + k, start, n, opened, 0))
                put(size - n, opened, k)
                opened += k
            else:
                first, count = rooms[room].pop()
                k, piece = min(r1 - r0, count), min(n, room)
                slots.append((length, r0, r0 + k, start, piece, first, size - room))
                if count > k:
                    rooms[room].append((first + k, count - k))
                elif not rooms[room]:
                    heapq.heappop(heap)
                put(room - piece, first, k)
                if piece < n:
                    bins[n - piece].append((length, r0, r0 + k, start + piece))
            if r0 + k < r1:
                bins[n].append((length, r0 + k, r1, start))
    return slots, packs


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start (ids of its document before it), length, ids_crc32 (of
    the ids as little-endian 32-bit numbers), doc_tokens, sequence_id and offset there;
    ``with_ids`` adds ids array<int>.

    A document is the ids of its text and end_id; null and empty texts are end_id alone. Each
    row is a document, repeated rows and null ids included. Sequences hold at most ``size``
    ids, and there is less than one sequence of padding in all. Other columns are ignored. An empty table gives an empty
    result. The input must give the same rows in one run.

    The driver sees one count per length below ``size``; its slots, a few per length, go to the
    executors. Ids are written once and shuffled once; ranks come from counts per input
    partition and length, which grow with the input and are joined by a shuffle."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > FILE_LIMIT:
        raise ValueError("the tokenizer is over 64 MB")
    sent = spark.sparkContext.broadcast(text)
    t = Tables(spark, "packing")
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("rid", T.LongType()), T.StructField("doc", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]

    def encode(batches):
        tokenizer = _tokenizer(sent.value)
        end = np.array([end_id], tokenizer.kind)
        for b in batches:
            data, at = _words.buffers(_words.binary(b.column(2)))
            for lo, hi in _words.chunks(at):
                ids = tokenizer.encode(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], end)
                n = [len(x) // tokenizer.kind.itemsize for x in ids]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["rid", "doc", "n", "ids"])
        tokenizer.forget()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    coded = t.store(rows.mapInArrow(encode, T.StructType(fields)), "ids")

    part, rest, full = F.shiftright("rid", 33).alias("part"), F.col("n") % size, F.floor(F.col("n") / size)
    sizes = coded.select("rid", part, rest.cast("int").alias("rest"), full.cast("long").alias("full"))
    histogram = {r.rest: r.c for r in sizes.where("rest > 0").groupBy("rest").agg(F.count("*").alias("c")).collect()}  # below size rows
    slots, packs = shortest_pack_first(histogram, size)
    chains: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
    for length, r0, _, start, n, first, offset in slots:
        chains[length, start].append((r0, n, first, offset))
    for c in chains.values():
        c.sort()
    plan = spark.sparkContext.broadcast(dict(chains))

    by_part = sizes.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum("full").alias("f"))
    rank0 = by_part.select("part", "rest", (F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c")).alias("rank0"))
    whole = by_part.groupBy("part").agg(F.sum("f").alias("f"))
    full0 = whole.select("part", (F.sum("f").over(Window.orderBy("part")) - F.col("f")).alias("full0"))  # a row per input partition
    starts = t.store(rank0.join(full0, "part"), "starts")
    within = sizes.select(
        "rid", "part", "rest", "full",
        (F.row_number().over(Window.partitionBy("part", "rest").orderBy("rid")) - 1).alias("rank"),
        (F.sum("full").over(Window.partitionBy("part").orderBy("rid")) - F.col("full")).alias("before"),
    )
    within = t.store(within, "within")
    ranked = within.join(starts.hint("shuffle_hash"), ["part", "rest"]).select("rid", "rest", "full", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("before") + F.col("full0") + packs).alias("first"))

    def place(frames):
        for f in frames:
            out = []
            for rest_, rank in zip(f["rest"].tolist(), f["rank"].tolist(), strict=True):
                start, pieces = 0, []
                while start < rest_:
                    chain = plan.value[rest_, start]
                    r0, n, first, offset = chain[bisect.bisect_right(chain, (rank, 2**62)) - 1]
                    pieces.append({"start": start, "n": n, "seq": first + rank - r0, "offset": offset})
                    start += n
                out.append(pieces)
            yield pd.DataFrame({"rid": f["rid"], "full": f["full"], "first": f["first"], "pieces": out})

    placed = ranked.mapInPandas(place, "rid long, full long, first long, pieces array<struct<start:long,n:long,seq:long,offset:long>>")
    placed = t.store(placed, "placed")

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out_fields = [T.StructField("doc", kind), *(T.StructField(x, T.LongType()) for x in names)]
    if with_ids:
        out_fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def emit(batches):
        kind_ = None
        for b in batches:
            kind_ = kind_ or _tokenizer(sent.value).kind
            take, cols = [], [[] for _ in range(7)]
            for i, (n, ids, whole_, first, pieces) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True)):
                wide = np.frombuffer(ids, kind_).astype("<u4")
                all_ = [(k * size, size, first + k, 0) for k in range(whole_)]
                all_ += [(whole_ * size + p["start"], p["n"], p["seq"], p["offset"]) for p in pieces]
                for start, length, seq, offset in all_:
                    piece = wide[start : start + length]
                    take.append(i)
                    for c, v in zip(cols, (start, length, zlib.crc32(piece.tobytes()), n, seq, offset, piece.tolist() if with_ids else None), strict=True):
                        c.append(v)
            arrays = [b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:6])]
            if with_ids:
                arrays.append(pa.array(cols[6], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in out_fields])

    joined = coded.join(placed.hint("shuffle_hash"), "rid").select("doc", "n", "ids", "full", "first", "pieces")
    return joined.mapInArrow(emit, T.StructType(out_fields)).withColumnRenamed("doc", id_col)
