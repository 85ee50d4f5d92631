"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how many copies of each of its documents the mix takes on
average. The whole part is taken for certain. The fractions are paired: words of chance move
from one document to the other, in a random direction that keeps both chances fair, until one
of the two is integral; the other goes on to the next pair. The expected words of the pair
never change, so a source keeps its total to the last open document.

The pairs form a reduction tree over columns only: documents of a source and a size class are
dealt to groups of bounded size by hash, each group leaves one or a few open documents, these
are dealt again. At the root, what is left of all classes, a few documents each, is taken from
long to short, and the partner of a document is the pool of all shorter ones at once, each
giving or taking in proportion to its slack. So a long document that nothing of its size can
meet is settled by many short ones, and the last one, rounded alone, is short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerroutes.llm._shared import Tables, places

GROUP = 256  # documents of one chain of pairs, on average
OPEN = 64  # a class with no more open documents is done
LAST = 32  # open documents that each of the last few groups of a class leaves
BLOCK = 1 << 16  # repeated rows that one task writes at once
TINY = 1e-12
ITEM = "struct<size:bigint,h:bigint,id:{id},rows:bigint,sure:bigint,mass:double,won:boolean>"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def _uniform(seed: int, *ids: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) / F.lit(2.0**53)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _settled(x: Column, mass: Column) -> Column:
    won = F.when(mass <= x["size"] * TINY, False).when(mass >= x["size"] * (1 - TINY), True)
    return F.struct(x["size"].alias("size"), x["h"].alias("h"), x["id"].alias("id"), x["rows"].alias("rows"), x["sure"].alias("sure"), mass.alias("mass"), won.alias("won"))


def _chain(items: Column, kind: str, seed: int) -> Column:
    """A chain of pairs over ``items``: struct of cur, the one still open (null if none), and done."""

    def pair(a: Column, b: Column) -> Column:
        to_a = F.least(a["size"] - a["mass"], b["mass"])
        to_b = F.least(a["mass"], b["size"] - b["mass"])
        move = _let(F.struct(to_a.alias("a"), to_b.alias("b")), lambda d: F.when(_uniform(seed, a["h"], b["h"]) * (d["a"] + d["b"]) < d["b"], d["a"]).otherwise(-d["b"]))
        return _let(move, lambda m: F.array(_settled(a, a["mass"] + m), _settled(b, b["mass"] - m)))

    def step(state: Column, x: Column) -> Column:
        after = _let(
            pair(state["cur"], x),
            lambda two: F.struct(F.get(F.filter(two, lambda y: y["won"].isNull()), F.lit(0)).alias("cur"), F.concat(state["done"], F.filter(two, lambda y: y["won"].isNotNull())).alias("done")),
        )
        return F.when(state["cur"].isNull(), F.struct(x.alias("cur"), state["done"].alias("done"))).otherwise(after)

    start = F.struct(F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, start, step)


def _pooled(items: Column, kind: str, seed: int) -> Column:
    """``items``, long ones first, all settled: each against the pool of those after it."""
    slack = lambda y: F.least(y["mass"], y["size"] - y["mass"])
    alone = lambda x: F.when(_uniform(seed, x["h"], F.lit(1)) * x["size"] < x["mass"], x["size"]).otherwise(0).cast("double")

    def against(x: Column, pool: Column, give: Column) -> Column:
        up, down = F.least(x["size"] - x["mass"], give), F.least(x["mass"], give)
        move = F.when(_uniform(seed, x["h"]) * (up + down) < down, up).otherwise(-down)

        def moved(m: Column) -> Column:
            first = _let(_settled(x, x["mass"] + m), lambda y: F.when(y["won"].isNull(), _settled(y, alone(y))).otherwise(y))
            others = F.transform(pool, lambda y: _settled(y, y["mass"] - m * slack(y) / give))
            return _let(others, lambda o: F.struct(F.filter(o, lambda y: y["won"].isNull()).alias("todo"), F.concat(F.array(first), F.filter(o, lambda y: y["won"].isNotNull())).alias("now")))

        return _let(move, moved)

    def step(state: Column, _: Column) -> Column:
        x, pool = state["todo"][0], F.slice(state["todo"], 2, F.size("all"))
        give = F.aggregate(pool, F.lit(0.0), lambda s, y: s + slack(y))
        last = F.struct(pool.alias("todo"), F.array(_settled(x, alone(x))).alias("now"))
        after = _let(give, lambda g: F.when(F.size(pool) == 0, last).otherwise(against(x, pool, g)))
        return F.when(F.size(state["todo"]) == 0, state).otherwise(_let(after, lambda a: F.struct(a["todo"].alias("todo"), F.concat(state["done"], a["now"]).alias("done"))))

    start = F.struct(items.alias("todo"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.size("all")), start, step)["done"]


def _targets(t: Tables, sources: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``sources`` (source, words) with sid, target and per (copies of a document on average).

    Words are shared by weight; sources above ``most`` times their size stop there and the rest
    is shared anew until none is above. Sums are exact integers; a round is one aggregate."""
    ranked = places(t, sources.withColumn("none", F.col("source").isNull()), [], ["none", "source"])
    ranked = t.store(ranked.select("source", "words", F.col("pos").alias("sid"), F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).alias("w")), "ranked")
    total = ranked.agg(F.sum("words")).first()[0] or 0
    wide, full, last = "decimal(19,0)", F.lit(False), None
    while True:
        words_full, w_free = ranked.agg(F.sum(F.when(full, F.col("words"))), F.sum(F.when(~full, F.col("w")))).first()
        if (words_full, w_free) == last or not w_free:
            break
        last = (words_full, w_free)
        num, den = percent * total - 100 * most * (words_full or 0), 100 * w_free
        full = F.col("words").cast(wide) * F.lit(most * den).cast(wide) <= F.col("w").cast(wide) * F.lit(num).cast(wide)
    share = F.lit(0.0)
    if w_free:
        for w in set(weights):
            share = F.when(F.col("w") == w, w * num / den).otherwise(share)
    target = F.when(full if w_free else F.lit(True), F.col("words") * float(most)).otherwise(share)
    per = F.when(F.col("words") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("words"))).otherwise(0.0)
    return t.store(ranked.withColumn("target", target).withColumn("per", per), "targets")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 12) -> DataFrame:
    """One row per row of ``docs``: id_col, group_col, size (words), source_size, target of its
    source, copies and taken (copies times size).

    Sources by code point, null last, take ``weights`` in turn and share ``percent`` per cent of
    all words, each up to ``most`` times its size. Copies of a document differ by less than one
    from target / source_size, equal it on average over seeds, and a source misses its target by
    less than one document. Null and empty texts have no words: nothing is taken, their copies
    are the whole part. A source without words has target 0. Null ids are ids. Rows alike in id,
    source and size share their copies evenly, and only how many of them get one more is said,
    not which (their output rows are the same but for that). Other columns are ignored. An empty
    table gives an empty result. The draw hashes ids and sizes, so reruns agree on any cluster.

    Partitioning: texts are read once, and only (id, source, size) is shuffled, with equal rows
    combined before. A source of any size is dealt to groups of about 256 documents; a level of
    the tree leaves at most an eighth of its open documents. The root sees at most 64 documents
    of each power of two of a source."""
    t = Tables(docs.sparkSession, "mixing")
    kind = ITEM.format(id=docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString())
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    items = t.store(rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "items")
    sources = _targets(t, items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words")), weights, percent, most)
    known = sources.select(F.col("source").alias("name"), "sid", "per")

    part = (F.col("per") - F.floor("per")) * F.col("rows")
    placed = items.join(known, F.col("source").eqNullSafe(F.col("name"))).withColumn("sure", F.floor(part))
    item = F.struct("size", F.xxhash64(F.lit(seed), "id", "size").alias("h"), "id", "rows", "sure", ((part - F.col("sure")) * F.col("size")).alias("mass"), F.lit(None).cast("boolean").alias("won"))
    # a chance that is 0 or 1 is settled at once, and so is a text without words
    placed = placed.select("sid", _let(item, lambda x: _settled(x, x["mass"])).alias("x"))
    placed = t.store(placed.select("sid", F.floor(F.log2(F.greatest(F.col("x.size"), F.lit(1)))).cast("int").alias("class"), "x"), "placed")
    done = [placed.where("x.won is not null").select("sid", "x")]
    now = placed.where("x.won is null")

    while True:
        level = len(done)
        sizes = t.store(now.groupBy("sid", "class").agg(F.count("*").alias("n")), "sizes")
        if sizes.where(F.col("n") > OPEN).isEmpty():
            break
        dealt = now.join(sizes, ["sid", "class"]).withColumn("groups", F.ceil(F.col("n") / GROUP))
        more = dealt.where(F.col("n") > OPEN).withColumn("group", F.pmod(F.xxhash64(F.lit(level), "x.h"), F.col("groups")))
        more = more.groupBy("sid", "class", "groups", "group").agg(F.array_sort(F.collect_list(F.struct("x.h", "x.id", "x"))).alias("all"))
        more = more.withColumn("all", F.transform("all", lambda y: y["x"])).withColumn("left", F.when(F.col("groups") <= OPEN, LAST - 1).otherwise(0))
        chained = F.greatest(F.size("all") - F.col("left"), F.lit(0))
        more = more.withColumn("made", _chain(F.slice("all", F.lit(1), chained), kind, seed))
        still = F.concat(F.filter(F.array("made.cur"), lambda y: y.isNotNull()), F.slice("all", chained + 1, F.size("all")))
        more = t.store(more.select("sid", "class", "made.done", still.alias("open")), "level")
        done.append(more.select("sid", F.explode("done").alias("x")))
        rest = dealt.where(F.col("n") <= OPEN).select("sid", "class", "x")
        now = t.store(rest.unionByName(more.select("sid", "class", F.explode("open").alias("x"))), "open")

    last = now.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct((-F.col("x.size")).alias("z"), "x.h", "x.id", "x"))).alias("all"))
    done.append(last.select("sid", F.explode(_pooled(F.transform("all", lambda y: y["x"]), kind, seed)).alias("x")))

    all_ = done[0]
    for d in done[1:]:
        all_ = all_.unionByName(d)
    facts = sources.select("sid", F.col("source").alias("name"), F.col("words").alias("source_size"), "target", F.floor("per").alias("base"))
    up = F.col("x.sure") + F.col("x.won").cast("long")
    counts = F.filter(F.array(F.struct((F.col("base") + 1).alias("copies"), up.alias("k")), F.struct(F.col("base").alias("copies"), (F.col("x.rows") - up).alias("k"))), lambda c: c["k"] > 0)
    out = all_.join(facts, "sid").select("sid", "x.id", "name", "x.size", "source_size", "target", F.explode(counts).alias("c"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("c.k") - 1) / BLOCK))).alias("block"))
    if not items.where(F.col("rows") > BLOCK).isEmpty():
        out = out.repartition("sid", "id", "size", "block")
    out = out.select("*", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(BLOCK), F.col("c.k") - F.col("block") * BLOCK).cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("name").alias(group_col), "size", "source_size", "target", "c.copies", (F.col("c.copies") * F.col("size")).alias("taken"))
