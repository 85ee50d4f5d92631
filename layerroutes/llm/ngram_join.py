"""N-gram Jaccard join: near-duplicate components of whole texts.

Texts become sets of word shingles. Two sets link when their Jaccard similarity reaches
``percent / 100``, tested in whole numbers. Filtering by several global token orders:

1. *Order by number.* The first tokens of each set under ascending token numbers (a random
   order), with room for ``l`` shared ones. A set survives only if ``l`` of these also lie in
   another set's prefix.
2. *Rarest first*, over the survivors. Tokens of one set only count as used up; a set with
   too few shared tokens goes. What stays is grouped by prefix token, and each group is
   compared with one leader, its most central set, so a group of m sets costs m - 1
   comparisons, not m * m.
3. *Orders of differences from the leader.* Two members that one leader did not join can only
   link if they share a difference from the leader. Differences that only one component has
   are used up; the others come rarest in the leader's group first. Members that share a
   prefix difference form a group again, which is compared with leaders of its own for a few
   rounds. What is in different components then is paired, unless counts of differences rule
   a link out or the prefixes under ascending numbers share no difference.
4. Every pair so found must also share a prefix token under ascending and under descending
   token numbers. All filters are intersected before the whole sets of a pair are loaded to
   verify it. Pairs of a set and its leader are loaded in any case: step 3 starts from their
   differences.

Every step is a necessary condition, so no link between different components is lost, and
there is no cap on groups, partners or candidates. After the rounds, what is left of a group in
different components is paired: m members that share a rare difference but no link cost m * m.

Why step 3 is whole: for sets x, y and leader L write dx for the symmetric difference of x
and L. x and y link only if |x ^ y| <= m(x, y) = (1-t)/(1+t) * (|x|+|y|), and |x ^ y| =
|dx| + |dy| - 2|dx & dy|. If x is not linked with L then |dx| > m(x, L), and m(x, y) -
m(x, L) <= |dy|, so |dx & dy| > 0. It is also at least |dx| - (1-t)/t * |x|, which bounds the
prefix of dx. Leaders of rounds settle all their pairs in the group and leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerroutes.llm import _words
from layerroutes.llm._shared import Tables, components


def _room(n: int) -> int:
    """Shared tokens that a set of n must have in its first prefix: 5 %, at least one."""
    return max(1, n // 20)


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle numbers of each text."""
    data, at = _words.buffers(column)
    for lo, hi in _words.chunks(at):
        h, first, _, _ = _words.numbers(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)
        for k in range(hi - lo):
            x = np.unique(_words.windows(h[first[k] : first[k + 1]], words))
            yield np.maximum(x, np.uint64(1))


def _key(x: np.ndarray) -> str:
    return hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if len(x) else ""


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).astype(np.uint64).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _first_pass(words: int, percent: int):
    def run(batches):
        for b in batches:
            sizes, keys, rooms, heads = [], [], [], []
            for x in shingle_sets(_words.binary(b.column(2)), words):
                n = len(x)
                sizes.append(n)
                keys.append(_key(x))
                rooms.append(_room(_need(n, percent)))
                heads.append(x[: n - _need(n, percent) + _room(n)] if n else x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(rooms, pa.int32()), _lists(heads)],
                ["rid", "doc", "n", "key", "room", "head"],
            )

    return run


def _second_pass(words: int):
    def run(batches):
        for b in batches:
            kept = []
            for x, key in zip(shingle_sets(_words.binary(b.column(1)), words), b.column(2).to_pylist(), strict=True):
                if _key(x) != key:
                    raise ValueError("the input changed between two reads; give a stored table")
                kept.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in kept], pa.int64()), _lists(kept)], ["rid", "n", "toks"])

    return run


def _values(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _stars(percent: int):
    """Rows (lead, rid, linked, n, gap, lu, diffs): is the pair linked (never where its prefixes do
    not ``agree``), and the member's differences from the leader. toks are the shared tokens. 0
    stands for the leader's lu tokens that no other survivor has: every member differs in
    these alike. gap counts all differences."""

    def run(batches):
        for b in batches:
            n, ln, lu, agree = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4, 5, 7))
            linked, diffs, gaps = [], [], []
            for i, (x, lead) in enumerate(zip(_values(b.column(3)), _values(b.column(6)), strict=True)):
                new, gone = x[~np.isin(x, lead)], lead[~np.isin(lead, x)]
                both = len(x) - len(new)
                linked.append(bool(agree[i]) and 100 * both >= percent * (int(n[i]) + int(ln[i]) - both))
                gaps.append(int(n[i]) + int(ln[i]) - 2 * both)
                d = np.concatenate([new, gone])
                diffs.append((np.append(d, np.int64(0)) if lu[i] else d).view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_()), b.column(2), pa.array(gaps, pa.int64()), b.column(5), _lists(diffs)], ["lead", "rid", "linked", "n", "gap", "lu", "diffs"])

    return run


def _verify(percent: int):
    """Rows (a, b) of rows (a, b, n, toks, m, toks2): the pairs that are linked."""

    def run(batches):
        for b in batches:
            n, m, keep = b.column(2).to_numpy(), b.column(4).to_numpy(), []
            for i, (x, y) in enumerate(zip(_values(b.column(3)), _values(b.column(5)), strict=True)):
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= percent * (int(n[i]) + int(m[i]) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _agreeing(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the column agree: do the prefixes of a and b share a token under
    ascending and under descending token numbers? Only prefixes are read."""
    one = sets.select(F.col("rid").alias(a), F.col("up").alias("up1"), F.col("down").alias("down1"))
    two = sets.select(F.col("rid").alias(b), F.col("up").alias("up2"), F.col("down").alias("down2"))
    agree = F.arrays_overlap("up1", "up2") & F.arrays_overlap("down1", "down2")
    return pairs.join(one, a).join(two, b).withColumn("agree", agree).drop("up1", "down1", "up2", "down2")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs(a, b)."""
    pairs = _agreeing(pairs, sets, "a", "b").where("agree")
    one = sets.select(F.col("rid").alias("a"), "n", "toks")
    two = sets.select(F.col("rid").alias("b"), F.col("n").alias("m"), F.col("toks").alias("toks2"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "toks", "m", "toks2")
    return full.mapInArrow(_verify(percent), "a long, b long")


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    comp = comp.select(F.col("node").alias("rid"), "comp")
    return rows.join(comp, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))


def _differences(t: Tables, stars: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Rows (lead, rid, n, gap, left, order, ups): the members of leaders that have more than
    one component. ``left`` counts the differences that another component has too; order is
    their prefix, rarest in the leader's group first, and ups that under ascending numbers."""
    members = _with_comp(stars, comp)
    several = members.groupBy("lead").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("lead")
    each = members.join(several, "lead", "left_semi").select("lead", "rid", "n", "gap", "lu", "comp", F.explode("diffs").alias("tok"))
    each = t.store(each, "differences")
    met = each.groupBy("lead", "tok").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("lead", "tok", "c")
    own = each.join(met, ["lead", "tok"]).groupBy("lead", "rid", "n", "gap", "lu").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("o"))  # one text's differences
    own = own.withColumn("left", F.size("o") + F.when(F.array_contains("o.tok", 0), F.col("lu") - 1).otherwise(0))
    room = F.least(F.col("gap"), F.floor(F.lit(100 - percent) * F.col("n") / percent) + 1) - (F.col("gap") - F.col("left"))
    own = own.withColumn("p", room.cast("int")).where("p > 0")
    ups = F.slice(F.sort_array("o.tok"), F.lit(1), F.col("p"))
    return t.store(own.select("lead", "rid", "n", "gap", "left", F.slice("o.tok", F.lit(1), F.col("p")).alias("order"), ups.alias("ups")), "ordered")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """Per row of ``docs``: id_col, n_shingles (size of its set) and component_id (smallest id
    reachable by links, its own included).

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text with fewer
    words than a shingle is one shingle; one without words, or null, has an empty set and is
    linked with nothing: its component_id is its own id. Rows with a null id take part; the
    smallest id ignores nulls, and a component of null ids only has null. Repeated rows are
    rows of their own in one component. Other columns are ignored. An empty table gives an
    empty result.

    Partitioning: one pass over the texts, a shuffle of about a fifth of the shingle numbers,
    and one of the texts for the sets that survive; everything after works on survivors. At
    most ``rounds`` rounds of leaders come before pairs are formed inside groups.
    Copies meet only in aggregates with map-side combine and joins that may be split."""
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent must be 1 to 100 and words at least 1")
    spark = docs.sparkSession
    t = Tables(spark, "ngram_join")
    id_type = docs.schema[id_col].dataType
    source = t.numbered(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")))
    rows = source.select("rid", "doc", "text")
    first = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc", id_type), T.StructField("n", T.LongType()), T.StructField("key", T.StringType()), T.StructField("room", T.IntegerType()), T.StructField("head", T.ArrayType(T.LongType()))])
    s1 = t.store(rows.mapInArrow(_first_pass(words, percent), first), "sets")

    classes = t.store(s1.where("n > 0").groupBy("key").agg(F.min("rid").alias("rid"), F.min("doc").alias("doc")), "classes")
    heads = s1.join(classes.select("rid"), "rid", "left_semi").select("rid", F.explode("head").alias("tok"))
    heads = t.store(heads, "heads")
    met = heads.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    hits = heads.join(met, "tok", "left_semi").groupBy("rid").agg(F.count("*").alias("hits"))
    left = s1.select("rid", "key", "room").join(hits, "rid").where("hits >= room").select("rid", "key")
    left = t.store(left, "survivors")
    t.drop(heads)

    again = rows.join(left, "rid").select("rid", "text", "key")
    s2 = t.store(again.mapInArrow(_second_pass(words), "rid long, n long, toks array<long>"), "tokens")
    each = s2.select("rid", F.explode("toks").alias("tok"))
    counts = t.store(each.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "df")
    shared = each.join(counts, "tok").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("o"))
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    s3 = s2.select("rid", "n").join(shared, "rid").where(F.size("o") >= need)
    central = F.aggregate("o.df", F.lit(0).cast("long"), lambda a, v: a + v) / F.col("n")
    s3 = s3.select("rid", "n", (F.col("n") - F.size("o")).alias("u"), central.alias("central"), (F.col("n") - need + 1).cast("int").alias("p"), F.col("o.tok").alias("toks"), F.sort_array("o.tok").alias("s"))
    first_p, last_p = F.slice("s", F.lit(1), F.col("p")), F.slice("s", F.greatest(F.size("s") - F.col("p"), F.lit(0)) + 1, F.col("p"))
    s3 = t.store(s3.select("rid", "n", "u", "central", "p", "toks", first_p.alias("up"), last_p.alias("down")), "rare")
    t.drop(s2, counts, source)

    prefix = (F.col("p") - F.col("u")).cast("int")
    post = s3.where(prefix > 0).select("rid", "central", F.explode(F.slice("toks", F.lit(1), F.greatest(prefix, F.lit(1)))).alias("tok"))
    leads = post.groupBy("tok").agg(F.max_by("rid", F.struct("central", "rid")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("tok", "lead")
    pairs = t.store(post.join(leads, "tok").where("rid <> lead").select("lead", "rid").distinct(), "pairs")
    lead = s3.select(F.col("rid").alias("lead"), F.col("n").alias("ln"), F.col("u").alias("lu"), F.col("toks").alias("ltoks"))
    full = _agreeing(pairs, s3, "lead", "rid").join(s3.select("rid", "n", "toks"), "rid").join(lead, "lead").select("lead", "rid", "n", "toks", "ln", "lu", "ltoks", "agree")
    stars = t.store(full.mapInArrow(_stars(percent), "lead long, rid long, linked boolean, n long, gap long, lu long, diffs array<long>"), "stars")
    comp = components(t, stars.where("linked").select(F.col("lead").alias("a"), F.col("rid").alias("b")))
    comp = t.store(comp, "components")

    ordered = _differences(t, stars, comp, percent)
    group = ordered.select("lead", "rid", "n", "gap", "left", F.posexplode("order").alias("at", "tok"))
    group = t.store(group.select("lead", "tok", "rid", "n", "gap", (F.col("left") - F.col("at")).alias("after")), "groups")
    most = F.lit(100 - percent) * (F.col("n") + F.col("m"))  # (100 + percent) * |x ^ y| is at most this in a link
    near = (F.lit(100) * F.least("n", "m")) >= (F.lit(percent) * F.greatest("n", "m"))
    near &= (F.lit(100 + percent) * F.abs(F.col("gap") - F.col("gap2"))) <= most
    # what can still be shared: this difference and those after it
    near &= (F.lit(100 + percent) * (F.col("gap") + F.col("gap2") - 2 * F.least("after", "after2"))) <= most
    named = {"rid": "b", "comp": "comp2", "n": "m", "gap": "gap2", "after": "after2"}

    for k in range(rounds + 1):
        mixed = _with_comp(group, comp)
        tops = mixed.groupBy("lead", "tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by("rid", F.struct("gap", "rid")).alias("top"), F.count("*").alias("c")).where("x <> y").select("lead", "tok", "top", "c")
        mixed = t.store(mixed.join(tops, ["lead", "tok"]), "mixed")
        size, twos = mixed.agg(F.coalesce(F.count("*"), F.lit(0)), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)) / 2).first()
        if not size:
            break
        last = k == rounds or twos <= 2 * size  # few pairs beside the rows themselves
        left = mixed.select("lead", "tok", "rid", "comp", "n", "gap", "after") if last else mixed.where("rid <> top").drop("top", "c")
        right = (left if last else mixed.where("rid = top")).select("lead", "tok", *(F.col(c).alias(d) for c, d in named.items()))
        apart = (F.col("comp") < F.col("comp2")) if last else (F.col("comp") != F.col("comp2"))
        found = left.join(right, ["lead", "tok"]).where(apart & near).select("lead", F.col("rid").alias("a"), "b").distinct()
        one, two = (ordered.select("lead", F.col("rid").alias(x), F.col("ups").alias(f"ups_{x}")) for x in "ab")
        found = found.join(one, ["lead", "a"]).join(two, ["lead", "b"]).where(F.arrays_overlap("ups_a", "ups_b"))
        found = t.store(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        if last and found.isEmpty():
            break
        comp = t.store(components(t, comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(_links(found, s3, percent))), "components")
        if last:
            break
        group = left.drop("comp")

    labelled = classes.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("key", "doc", F.coalesce("comp", "rid").alias("comp"))
    labelled = t.store(labelled, "labelled")
    smallest = labelled.groupBy("comp").agg(F.min("doc").alias("component_id"))
    by_key = t.store(labelled.join(smallest, "comp").select("key", "component_id"), "by_key")
    out = s1.select("doc", "n", "key").join(by_key, "key", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
