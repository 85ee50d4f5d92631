"""SHA-256 of files of any size, a bounded piece of a file in a task.

A digest runs over a file in order, but not in one task: the bytes are stored in pieces, and a
round of tasks takes up each file's digest where the round before has left it."""

import ctypes
import hashlib
import itertools
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerroutes.sources.scratch import shared_dir

CONTEXT = 112  # bytes of OpenSSL's SHA256_CTX
BOM = b"\xef\xbb\xbf"
PIECES = "path string, start long, at long, n long, content binary"


class Resumed:
    """SHA-256 by OpenSSL, begun anew or from the ``state`` of another."""

    def __init__(self, state: bytes | None = None):
        import _hashlib  # not in every Python

        self.lib = ctypes.CDLL(_hashlib.__file__)
        self.context = ctypes.create_string_buffer(state or b"", CONTEXT)
        if state is None:
            self.lib.SHA256_Init(self.context)

    def update(self, content: bytes) -> None:
        self.lib.SHA256_Update(self.context, content, ctypes.c_size_t(len(content)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.context)
        return out.raw.hex()


def resumable() -> bool:
    """Whether this Python's OpenSSL offers the calls, and they give hashlib's digest."""
    try:
        first = Resumed()
        first.update(b"a" * 99)
        second = Resumed(first.state())
        second.update(b"b" * 99)
        return second.hexdigest() == hashlib.sha256(b"a" * 99 + b"b" * 99).hexdigest()
    except (AttributeError, ImportError, OSError):
        return False


def plain(path: str) -> str:
    """A path that Spark's readers take as it is, not as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The bytes of files as rows (path, start, at, n, content), in their order by (start, at):
    Spark's text reader splits a file at line feeds, which are put back, one more at the end of
    a file without one. It leaves out a byte-order mark at the start."""
    lines = spark.read.option("lineSep", "\n").text([plain(p) for p in paths]).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        at = 0
        for b in batches:
            rows = zip(b["path"].to_pylist(), b["start"].to_pylist(), b["value"].to_pylist())
            for (path, start), own in itertools.groupby(rows, lambda r: r[:2]):
                content = b"".join(x for r in own for x in (r[2], b"\n"))
                yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "at": [at], "n": [len(content)], "content": pa.array([content], pa.binary())})
                at += 1

    return lines.mapInArrow(run, PIECES)


def sha256(spark: SparkSession, files: dict[str, tuple[str, int]], piece: int) -> dict[str, str]:
    """Digests of ``files``, few and large ones, by ``_metadata.file_path``, given with path and
    length; a task reads about ``piece`` bytes of each file it meets. A stretch without a line feed must fit a task. Where OpenSSL's
    digests cannot be resumed, one task reads all pieces of a file, still not at once."""
    folder = f"{shared_dir(spark)}/digests/{uuid.uuid4().hex}"
    lengths = {p: n for p, (_, n) in files.items()}
    _pieces(spark, [p for p, _ in files.values()]).withColumn("part", F.floor(F.col("start") / piece)).write.option("compression", "none").partitionBy("part").parquet(folder)
    stored = spark.read.schema(PIECES + ", part long").parquet(folder)
    sums = stored.groupBy("path").agg(F.sum("n").alias("n"), F.max(F.struct("start", "at")).alias("last")).collect()  # a row a file
    beyond, last = {r.path: r.n - lengths[r.path] for r in sums}, {r.path: tuple(r.last) for r in sums}
    if odd := [p for p in lengths if beyond.get(p) not in (0, 1, -2, -3)]:
        raise ValueError(f"files were not read as they are: {odd}")
    handed, held, told = resumable(), {}, {}
    for part in range(max(lengths.values()) // piece + 1) if handed else [None]:

        def run(batches, held=dict(held)):
            rows = ((p, (s, a), c.as_py()) for b in batches for p, s, a, c in zip(b["path"].to_pylist(), b["start"].to_pylist(), b["at"].to_pylist(), b["content"]))
            for path, own in itertools.groupby(rows, lambda r: r[0]):
                digest, place = Resumed(held.get(path)) if handed else hashlib.sha256(), None
                if path not in held and beyond[path] < 0:
                    digest.update(BOM)
                for _, place, content in own:
                    digest.update(content[:-1] if place == last[path] and beyond[path] in (1, -2) else content)
                whole = place == last[path]
                yield pa.RecordBatch.from_pydict({"path": [path], "state": pa.array([None if whole else digest.state()], pa.binary()), "sha256": pa.array([digest.hexdigest() if whole else None], pa.string())})

        own = stored if part is None else stored.where(F.col("part") == part)
        for r in own.repartition("path").sortWithinPartitions("path", "start", "at").drop("part").mapInArrow(run, "path string, state binary, sha256 string").collect():  # a row a file
            if r.sha256:
                told[r.path] = r.sha256
            else:
                held[r.path] = bytes(r.state)
    return told
