"""Merkle manifest of a table: every row a leaf, every group a tree of 16-way runs, and a tree
over the groups' roots.

A level is kept as concatenated strings: an aligned block of 256 nodes is one string of
fixed-width hex digests. Substrings of 16 digests hash to the parents, which again make a
string; what flanks a digest within its run are its siblings. A block climbs two levels, its
top digest is a node of the next round, and so on until each group has one root; the roots
recurse the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerroutes.llm._shared import Tables, places

WIDTH = 16
HEX = 64
RUN = WIDTH * HEX
BLOCK_BITS = 8  # 256 nodes: two levels
BLOCK = 1 << BLOCK_BITS
FLANKS = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    """SHA-256 of fields as lowercase hex: ``-`` for null, else UTF-8 byte count, colon, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(proof, leaf, lambda h, f: F.sha2(F.concat(f["left"], h, f["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda f: F.concat(f["left"], f["right"])), ""), 256)


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / RUN).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(level.substr(i * RUN + 1, F.lit(RUN)), 256)), "")


def _flanks(level: Column, i: Column) -> Column:
    """Siblings of digest ``i`` within its run of the level."""
    run, own = F.floor(i / WIDTH).cast("int") * RUN, i * HEX
    return F.struct(level.substr(run + 1, own - run).alias("left"), level.substr(own + HEX + 1, run + RUN - own - HEX).alias("right"))


def _trees(t: Tables, nodes: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """From nodes (grp, pos, n, node and the columns ``keep``; pos from 0 to n - 1 within each
    grp): rows (grp, ``keep``, proof, root), and a row (grp, root) per grp."""
    items = F.array_sort(F.collect_list(F.struct("pos", "node", *(k for k in keep if k not in ("pos", "node")))))
    blocks = nodes.groupBy("grp", "n", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(items.alias("items"))
    blocks = blocks.withColumn("s0", F.array_join(F.transform("items", lambda x: x["node"]), ""))
    blocks = blocks.withColumn("s1", F.when(F.col("n") > 1, _parents(F.col("s0"))))
    blocks = t.store(blocks.withColumn("s2", F.when(F.col("n") > WIDTH, _parents(F.col("s1")))), "blocks", "zstd")

    top = F.when(F.col("n") <= BLOCK, F.coalesce("s2", "s1", "s0"))
    up = blocks.where(F.col("n") > BLOCK).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("s2").alias("node"))
    if up.isEmpty():
        blocks = blocks.withColumns({"above": F.array().cast(FLANKS), "root": top})
    else:
        above = t.store(_trees(t, up, ["pos"])[0].select("grp", F.col("pos").alias("block"), F.col("proof").alias("above"), F.col("root").alias("over")), "above", "zstd")
        blocks = blocks.join(above, ["grp", "block"], "left").withColumns({"above": F.coalesce("above", F.array().cast(FLANKS)), "root": F.coalesce("over", top)})

    def own(i: Column) -> Column:
        low, high = _flanks(F.col("s0"), i), _flanks(F.col("s1"), F.floor(i / WIDTH).cast("int"))
        return F.when(F.col("n") == 1, F.array().cast(FLANKS)).when(F.col("n") <= WIDTH, F.array(low)).otherwise(F.array(low, high))

    each = F.explode(F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(own(i), F.col("above")).alias("proof"))))
    rows = blocks.select("grp", "root", each.alias("x")).select("grp", *(F.col(f"x.item.{k}").alias(k) for k in keep), "x.proof", "root")
    return rows, blocks.where("block = 0").select("grp", "root")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, leaf (``digest`` of ``fields``), subroot of its group,
    root of all groups, proof, and the string columns ``keep`` (name to expression over ``docs``).

    Leaves of a group ascend by id; while more than one node remains, every 16 consecutive ones
    (the last run may be shorter, even one) become the digest of their hex digests. A lone leaf
    is its group's subroot, and a lone subroot the root. Groups follow one another as strings by
    bytes. Null ids and null groups come first; rows of one id are ordered by their leaf, so
    repeated rows take neighbouring places with the same content. Null and empty texts differ.
    Other columns are ignored; an empty table gives an empty result. ``proof`` holds, from the
    leaf upwards, what stands left and right of the node in its run.

    Partitioning: texts are read once and never shuffled, only digests are. Places come from
    range partitions and their counts, so a group of any size, or one id alone, is spread over
    tasks; a task holds one block of 256 nodes at a time."""
    t, keep = Tables(docs.sparkSession, "merkle"), keep or {}
    kept = [f"k{i}" for i in range(len(keep))]
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("source"), digest(*(F.col(f) for f in fields)).alias("node"), *(c.alias(k) for k, c in zip(kept, keep.values())))
    leaves = t.store(leaves.withColumn("rid", F.monotonically_increasing_id()), "leaves", "zstd")
    sources = places(t, leaves.select("source").distinct(), [], ["source"]).select(F.col("source").alias("s"), F.col("pos").alias("grp"), F.col("n").alias("groups"))
    sources = t.store(sources, "sources")
    placed = places(t, leaves, ["source"], ["id", "node", "rid"])
    nodes = placed.join(sources, F.col("source").eqNullSafe(F.col("s"))).select("grp", "pos", "n", "node", "id", *kept)
    rows, roots = _trees(t, nodes, ["id", "node", *kept])
    tops = roots.join(sources, "grp").select(F.lit(0).alias("grp"), F.col("grp").alias("pos"), F.col("groups").alias("n"), F.col("root").alias("node"))
    over, _ = _trees(t, tops, ["pos"])
    over = t.store(over.select(F.col("pos").alias("grp"), F.col("proof").alias("over"), F.col("root").alias("top")), "tops", "zstd")
    out = rows.join(over, "grp")
    return out.select(
        F.col("id").alias(id_col), F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("proof", "over").alias("proof"),
        *(F.col(k).alias(name) for k, name in zip(kept, keep)),
    )
