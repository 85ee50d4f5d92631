"""Exact dedup and the n-gram join against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from layerroutes.llm.exact_dedup import exact_duplicates
from layerroutes.llm.ngram_join import near_duplicates

SCHEMA = "doc_id long, text string, rid string, name string, n long"  # names that the operators use inside


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", None, 7) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, ids, k, percent):
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(sets)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {(ids[i], len(sets[i]), least[find(i)]) for i in range(len(sets))}


def corpus(seed, families=6, size=12, length=60):
    """Families of near copies at mixed distances, a passage that many share, copies and odd texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(25)]
    out = ["", None, "   \n", "one", "ONE", "one two", "one  two\n", "é É", " "]
    for _ in range(families):
        base = [r.choice(vocab) for _ in range(r.randint(8, length))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 2)] = [r.choice(vocab + ["same"] * 200) for _ in range(r.randint(0, 2))]
            out.append(" ".join(w))
    for _ in range(10):
        own = [r.choice(vocab) for _ in range(r.randint(2, 30))]
        out.append(" ".join(own[:5] + passage + own[5:]))
    out += [out[12], out[12], out[15].upper()]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 1, 90)])
def test_near_duplicates_match_brute_force(spark, seed, k, percent):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = {tuple(r) for r in near_duplicates(frame(spark, texts, ids).repartition(3, "doc_id"), words=k, percent=percent).collect()}
    assert got == brute_components(texts, ids, k, percent)


def test_near_duplicates_edges(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    long = " ".join(f"a{i % 7919}" for i in range(300_000))
    rows = near_duplicates(frame(spark, [long, long + " tail", "x", "x", None], [5, 3, 9, 9, None])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in rows) == [(-1, None), (3, 3), (5, 3), (9, 9), (9, 9)]


def brute_groups(texts, ids):
    out, groups = set(), {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in zip(ids, norm, strict=True):
        groups.setdefault(t, []).append(i)
    for i, t in zip(ids, norm, strict=True):
        g = groups[t]
        out.add((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long") % 2])
def test_exact_duplicates_match_brute_force(spark, digest):
    r = random.Random(5)
    texts = ["", None, " ", "\t\n", "a b", "a\tb", "a \n b", "ab", " ", "𝒳" * 9, "𝒳" * 8]
    texts += ["".join(r.choice("ab \n") for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += ["x" * 50 + c + "y" * 50 for c in "pqpq"] * 3
    ids = r.sample(range(5000), len(texts))
    got = exact_duplicates(frame(spark, texts, ids), block_chars=4, digest=digest).collect()
    assert len(got) == len(texts)
    assert {tuple(x) for x in got} == brute_groups(texts, ids)


def test_exact_duplicates_edges(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0
    got = exact_duplicates(frame(spark, ["a", "a", "a", "b" * 100_000], [4, 4, None, None])).collect()
    assert sum(x.kept for x in got) == 2
    assert sorted(x.group_size for x in got) == [1, 3, 3, 3]
    assert {x.keep_id for x in got} == {4, None}
