"""Merkle manifest against a plain recursion."""

import hashlib
import random

from pyspark.sql import functions as F

from layerroutes.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, root string, grp string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    return H(*(field(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))


def climb(level):
    """Root, and per leaf its (left, right) siblings."""
    proofs, owners = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        for i, own in enumerate(owners):
            a = i // 16 * 16
            for o in own:
                proofs[o].append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        level = [H(*level[a : a + 16]) for a in range(0, len(level), 16)]
        owners = [sum(owners[a : a + 16], []) for a in range(0, len(owners), 16)]
    return level[0], proofs


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, subs = [], []
    for s in names:
        g = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        sub, proofs = climb([leaf(r) for r in g])
        subs.append(sub)
        out.append([(r["doc_id"], leaf(r), sub, p) for r, p in zip(g, proofs)])
    root, above = climb(subs)
    return sorted((str(i), x, sub, root, tuple(p + above[k])) for k, rows_ in enumerate(out) for i, x, sub, p in rows_)


def compare(spark, rows):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "x", None) for r in rows], SCHEMA).repartition(5)
    made = merkle.manifest(docs, keep={"seen": merkle.digest(F.col("text"))})
    got = made.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("wrong", merkle.fold(F.col("seen"), F.col("proof"))).withColumn("d", merkle.proof_digest(F.col("proof"))).collect()
    assert sorted((str(x.doc_id), x.leaf, x.subroot, x.root, tuple((f.left, f.right) for f in x.proof)) for x in got) == expected(rows)
    assert all(x.again == x.root and x.wrong != x.root for x in got)
    assert all(x.d == H(*(f.left + f.right for f in x.proof)) for x in got)


def row(i, source, text="t", lang="en", n=3):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


def test_groups_of_all_sizes_nulls_and_ties(spark):
    r = random.Random(1)
    rows = [row(i, "hot", r.choice(["", None, "Über Ä", "a" * 5000]), r.choice(["de", None]), r.choice([None, 4])) for i in range(530)]
    for name, n in (("one", 1), (None, 17), ("", 16), ("ß", 256), ("z", 257), ("Z", 3)):
        rows += [row(1000 + 7 * i, name, f"Text {i}") for i in range(n)]
    rows += [row(None, "hot"), row(None, "hot", "u"), row(5, "hot"), row(5, "hot"), row(5, "hot", "z")]
    rows += [row(10_000, f"s{i:03}") for i in range(30)]
    compare(spark, rows)


def test_one_row_and_no_rows(spark):
    compare(spark, [row(3, "a")])
    compare(spark, [row(3, None, None, None, None)])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_repeated_row_is_spread_over_partitions(spark):
    compare(spark, [row(1, "a")] * 600)


def test_very_long_text(spark):
    compare(spark, [row(i, "a", "Ab " * 700_000 if i == 1 else "x") for i in range(18)])
