"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only
buckets over the byte limit split on another bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.llm._shared import Tables

BITS = 52  # 13 hex digits, which a double holds too
STEP = 13  # bits looked at in one round


def shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, depth (bits of its bucket), shard (these bits), n_bytes and
    shard_bytes.

    The hash is the first 52 bits of md5 of the id as text. A bucket splits while it is over
    ``limit_bytes`` and holds more than one hash. Rows of one hash, repeated ids, cannot be told
    apart by bits: if they alone are over the limit they are dealt in input order to numbered
    parts at depth 52 (column part, else 0), and a single text over the limit is a part alone.
    Null ids hash as empty text; null texts have no bytes. Other columns are ignored. An empty
    table gives an empty result.

    Each round is one aggregate over 13 further bits, of the rows in oversized buckets only;
    texts never move, just ids and byte counts."""
    t = Tables(docs.sparkSession, "sharding")
    digits = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc"), F.conv(digits, 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = t.store(rows, "rows")
    hashes = rows.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
    hashes = t.store(hashes, "hashes")

    left, leaves = hashes, None
    for low in range(0, BITS, STEP):
        high = min(low + STEP, BITS)
        fine = left.groupBy(F.shiftright("h", BITS - high).alias("p")).agg(F.sum("b").alias("b"))
        depths = fine.select("p", "b", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        at = F.expr(f"shiftright(p, cast({high} - depth as int))")
        sums = depths.groupBy("depth", at.alias("q")).agg(F.sum("b").alias("size"))
        fits = depths.withColumn("q", at).join(sums.where((F.col("size") <= limit_bytes) | (F.col("depth") == BITS)), ["depth", "q"])
        found = fits.groupBy("p").agg(F.min(F.struct("depth", "q", "size")).alias("leaf"))
        found = t.store(found.select("p", "leaf.depth", F.col("leaf.q").alias("shard"), F.col("leaf.size").alias("shard_bytes")), "leaves")
        placed = left.select("h", "c", "b", F.shiftright("h", BITS - high).alias("p")).join(found, "p", "left")
        placed = t.store(placed.select("h", "c", "b", "depth", "shard", "shard_bytes"), "placed")
        done = placed.where("depth is not null").select("h", "depth", "shard", "shard_bytes")
        leaves = done if leaves is None else leaves.unionByName(done)
        left = placed.where("depth is null").select("h", "b", "c")
        if left.isEmpty():
            break
    leaves = t.store(leaves, "directory")

    out = rows.join(leaves, "h")
    over = leaves.where(F.col("shard_bytes") > limit_bytes).select("h")
    out = out.withColumn("part", F.lit(0).cast("long"))
    if not over.isEmpty():
        # one hash over the limit: parts by running bytes, over input partitions first
        heavy = t.store(rows.join(over, "h").withColumn("task", F.shiftright("rid", 33)), "heavy")
        by_task = heavy.groupBy("h", "task").agg(F.sum("n_bytes").alias("b"))
        before = by_task.select("h", "task", (F.sum("b").over(Window.partitionBy("h").orderBy("task")) - F.col("b")).alias("before"))
        run = F.sum("n_bytes").over(Window.partitionBy("h", "task").orderBy("rid")) - F.col("n_bytes")
        # a text belongs to the half limit in which it begins; two such halves never exceed it
        half = max(1, limit_bytes // 2)
        parts = heavy.withColumn("run", run).join(before, ["h", "task"]).select("rid", (F.floor((F.col("run") + F.col("before")) / half)).cast("long").alias("part0"), F.col("n_bytes").alias("n0"))
        parts = parts.select("rid", F.when(F.col("n0") > half, 2 * F.col("rid") + 1).otherwise(2 * F.col("part0")).alias("part2"))
        out = out.join(parts, "rid", "left").withColumn("part", F.coalesce("part2", "part")).drop("part2")
    return out.select(F.col("doc").alias(id_col), "depth", "shard", "part", "n_bytes", "shard_bytes")
