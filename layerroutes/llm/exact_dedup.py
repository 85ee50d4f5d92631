"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of characters. Distinct blocks are sorted by
their 64-bit digest, and by content where several contents share one, and take their place as
an integer name; adjacent names are paired, distinct pairs are sorted and named, and so on
until each text has one name. Equal names at equal block counts mean equal texts, whatever a
digest would say: a digest of two contents is found by comparing contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerroutes.llm._shared import Tables

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(t: Tables, distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows in sorted order with their place as an integer. Sorting runs over range
    partitions; the table is stored, so that a lost executor cannot change a name."""
    ranged = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return t.store(ranged.select(*keys, F.monotonically_increasing_id().alias("name")), "names")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, digest=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id (id of the row of its group that stays),
    group_size, kept and text_sha256 of the normalised text.

    Null and empty texts are equal texts, and so are texts of white space only (one space).
    The row with the smallest id stays; a null id comes last; of rows that tie, repeated ones
    included, one stays, so each group has exactly one kept row. Other columns are ignored. An
    empty table gives an empty result. ``digest`` is a column function to long; any will do.

    Partitioning: the blocks' texts are shuffled once, combined on the map side first, so hot
    copies shrink to a row a task. Names are joined back through digests only."""
    t = Tables(docs.sparkSession, "exact_dedup")
    source = t.numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    rows = source.withColumn("text", normalised(F.col("text")))
    blocks = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    cut = rows.select("rid", "doc", "text", blocks.alias("blocks"))

    ids = t.store(cut.select("rid", "doc", F.sha2("text", 256).alias("sha"), F.transform("blocks", lambda b: digest(b)).alias("digests")), "texts")
    each = cut.select("rid", F.posexplode("blocks").alias("at", "block")).select("rid", "at", "block", digest("block").alias("d"))
    contents = each.groupBy("d", "block").agg(F.count("*").alias("c"))
    # a digest of two contents: rare enough to be looked up by content
    clashes = t.store(contents.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").select("d"), "clashes")

    names = ids.select("rid", F.posexplode("digests").alias("at", "a"))
    if clashes.isEmpty():
        names = names.withColumn("b", F.lit(0).cast("long"))
    else:
        told = each.join(clashes, "d").select("rid", "at", "d", "block")
        told = t.store(told, "told")
        apart = _named(t, told.select("d", "block").distinct(), ["d", "block"])
        which = told.join(apart, ["d", "block"]).select("rid", "at", (F.col("name") + 1).alias("b"))
        names = names.join(which, ["rid", "at"], "left").select("rid", "at", "a", F.coalesce("b", F.lit(0)).alias("b"))

    level, done = 0, None
    current = t.store(names, "level")  # rid, at, and the pair (a, b) that is to be named
    t.drop(source)
    while True:
        named = _named(t, current.select("a", "b").distinct(), ["a", "b"])
        got = t.store(current.join(named, ["a", "b"]).select("rid", "at", "name"), "named")
        t.drop(current, named)
        ends = got.groupBy("rid").agg(F.max("at").alias("last"), F.max("name").alias("name"))
        single = ends.where("last = 0").select("rid", F.lit(level).alias("level"), "name")
        single = t.store(single, "single")
        done = single if done is None else done.unionByName(single)
        more = got.join(ends.where("last > 0").select("rid"), "rid", "left_semi")
        half = more.groupBy("rid", F.floor(F.col("at") / 2).cast("int").alias("half")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).cast("long").alias("b"),
        )
        current = t.store(half.withColumnRenamed("half", "at").select("rid", "at", "a", "b"), "level")
        t.drop(got)
        level += 1
        if current.isEmpty():
            break

    known = t.store(ids.select("rid", "doc", "sha").join(done, "rid"), "identities")
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("rid").alias("rid"))
    groups = known.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    groups = t.store(groups, "groups")
    out = known.join(groups, ["level", "name"])
    return out.select(F.col("doc").alias(id_col), F.col("first.doc").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha").alias("text_sha256"))
