"""WARC archives: a writer and a sequential reader.

Archives hold one gzip member per record. The reader takes a file in small reads, inflates
members one after the other, frames each record by its Content-Length, and checks the digests
of block and payload while the bytes pass. Tasks open files through ``pyarrow.fs``, so that
archives can lie in any store it knows."""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerroutes.llm._shared import Tables, new_path

READ = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, record_type string, page string, uri string, refers string, payload_bytes long, payload_digest string, payload binary"


READERS = 1 << 14


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str | None, uri: str | None, payload: bytes, payload_digest: str, refers: str | None, revisit: bool, own: uuid.UUID | None = None, of: uuid.UUID | None = None) -> bytes:
    """One record: an HTTP response, or a revisit that has its head only. ``own`` is its record
    ID, ``of`` that of the response it revisits."""
    quote = lambda s: urllib.parse.quote(s, safe="")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{own or uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(uri, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if page is not None:
        lines.append(f"WARC-Page-ID: {quote(page)}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if of is not None:
            lines.append(f"WARC-Refers-To: <urn:uuid:{of}>")
        if refers is not None:
            lines.append(f"WARC-Refers-To-Page-ID: {quote(refers)}")
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _inflated(file) -> Iterator[bytes | None]:
    """The content of a file in pieces, None after each gzip member."""
    z, rest = zlib.decompressobj(31), b""
    started = False
    while True:
        data = rest or file.read(READ)
        if not data:
            if started:
                raise ValueError("the archive ends inside a gzip member")
            return
        started = True
        out = z.decompress(data, READ * 4)
        rest = z.unconsumed_tail
        if out:
            yield out
        if z.eof:
            rest = z.unused_data
            z, started = zlib.decompressobj(31), False
            yield None


def read_records(file, with_payload: bool = True) -> Iterator[dict]:
    """The records of one open archive, in order. Memory: one piece, and one payload where
    payloads are asked for."""
    pieces = _inflated(file)
    while True:
        head = b""
        while b"\r\n\r\n" not in head:
            piece = next(pieces, None)
            if piece is None:
                if head:
                    raise ValueError("a gzip member without a whole WARC head")
                return
            head += piece
        head, _, body = head.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(h["content-length"])
        block, payload, http, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        in_head, tail = True, b""
        while True:
            use, body = body[:left], body[left:]
            left -= len(use)
            block.update(use)
            if in_head:
                http += use
                if b"\r\n\r\n" in http:
                    http, _, use = http.partition(b"\r\n\r\n")
                    in_head = False
                else:
                    use = b""
            payload.update(use)
            size += len(use)
            if with_payload and use:
                kept.append(use)
            tail += body
            if (piece := next(pieces, None)) is None:
                break
            body = piece
        if left or tail != b"\r\n\r\n":
            raise ValueError("Content-Length and gzip member disagree")
        b32 = lambda x: "sha1:" + base64.b32encode(x.digest()).decode()
        revisit = h["warc-type"] == "revisit"
        if h.get("warc-block-digest", b32(block)) != b32(block):
            raise ValueError("block digest differs")
        if not revisit and h.get("warc-payload-digest", b32(payload)) != b32(payload):
            raise ValueError("payload digest differs")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        unquote = lambda s: None if s is None else urllib.parse.unquote(s)
        yield {
            "record_type": h["warc-type"],
            "page": unquote(h.get("warc-page-id")),
            "uri": h.get("warc-target-uri"),
            "refers": unquote(h.get("warc-refers-to-page-id")),
            "payload_bytes": int(fields.get("content-length", size)) if revisit else size,
            "payload_digest": h.get("warc-payload-digest", b32(payload)).partition(":")[2],
            "payload": b"".join(kept) if with_payload and not revisit else None,
        }


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives at ``archives.archive`` (URIs); a task reads whole archives,
    one after the other, and there are at most READERS tasks. Damaged archives fail."""
    n = archives.count()

    def run(batches):
        schema = pa.schema([("archive", pa.string()), ("record_type", pa.string()), ("page", pa.string()), ("uri", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = _open(path)
                rows, held = [], 0
                with store.open_input_stream(name) as file:
                    for r in read_records(file, with_payload):
                        rows.append(r | {"archive": path})
                        held += len(r["payload"] or b"")
                        if len(rows) == 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive").repartition(min(max(1, n), READERS)).mapInArrow(run, RECORD)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the archives written: archive (URI),
    records. Payloads are the html in UTF-8; null is empty.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest id (null is
    smallest, of rows that tie one) is a response, the others revisit it; smaller payloads are
    all responses. Null ids and urls have no header. An empty table writes nothing. Other
    columns are ignored. Archives end at about ``roll_bytes``. Each task attempt writes files of
    its own and only those of the attempt that counts are returned, so that lost executors
    leave at most files that nobody reads.

    Payloads are shuffled once, by digest, in a join that adaptive execution may split; groups
    of copies are found by an aggregate with map-side combine."""
    t = Tables(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"").cast("binary"))
    source = t.numbered(pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload")))
    rows = source.withColumn("key", F.sha2("payload", 256))
    last = F.max(F.struct("id", "rid")).alias("last")
    groups = rows.where(F.length("payload") >= min_bytes).groupBy("key").agg(last, F.count("*").alias("c")).where("c > 1")
    groups = t.store(groups.select("key", F.col("last.id").cast("string").alias("refers"), F.col("last.rid").alias("first")), "copies")
    marked = rows.join(groups, "key", "left").select("page", "uri", "payload", "refers", F.coalesce(F.col("first") != F.col("rid"), F.lit(False)).alias("revisit"), "rid", "first")

    space = uuid.uuid5(uuid.NAMESPACE_URL, folder)

    def named(rid: int) -> uuid.UUID:  # the same in every attempt
        return uuid.uuid5(space, str(rid))

    def run(batches):
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        attempt, out, n, size, done = uuid.uuid4().hex, None, 0, 0, []
        for b in batches:
            for page, uri, data, refers, revisit, rid, first in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if out is None:
                    name, n, size = f"{attempt}-{len(done):05d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name}")
                z = member(record(page, uri, data, digest(data), refers, revisit, named(rid), named(first) if revisit else None), level)
                out.write(z)
                n, size = n + 1, size + len(z)
                if size >= roll_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", n))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    written = t.store(marked.mapInArrow(run, "archive string, records long"), "archives")
    t.drop(source)
    return written


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: id_col,
    payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    kind = pages.schema[id_col].dataType
    back = read_archives(spark, write_archives(pages, folder, id_col, url_col, html_col, min_bytes))
    return back.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))
