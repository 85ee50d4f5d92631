"""Mixing against a plain computation of targets, and the properties of the rounding."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from layerroutes.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, size long, target double, sid int, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 0.5, 2, "x") for i, t, s in rows], SCHEMA).repartition(3)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    """Words by weight; what is above twice a source's size is shared again among the others."""
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    got, free, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(3 * sum(total.values()), 2)
    while left and free:
        for s in free:
            got[s] += left * w[s] / sum(w[x] for x in free)
        over = {s for s in free if got[s] > 2 * total[s]}
        left = sum(got[s] - 2 * total[s] for s in over)
        for s in over:
            got[s] = Fraction(2 * total[s])
        # only sources below their limit take what is over; weights among them stay in proportion
        left, free = left, free - over
        if not over:
            break
    return total, got


def check(spark, rows, **kw):
    total, want = targets(rows)
    got = mix(frame(spark, rows), **kw).collect()
    assert Counter((x.doc_id, x.source, x.size) for x in got) == Counter((i, s, size(t)) for i, t, s in rows)
    taken = defaultdict(int)
    for x in got:
        assert x.source_size == total[x.source] and x.target == pytest.approx(float(want[x.source]), rel=1e-12)
        assert x.taken == x.copies * x.size and x.copies in (0, 1, 2)
        assert total[x.source] == 0 or abs(x.copies - want[x.source] / total[x.source]) < 1 + 1e-9
        taken[x.source] += x.taken
    return got, taken, want


def texts(r, n, top):
    return " ".join("w" * r.randint(1, 3) for _ in range(min(n, top)))


def test_targets_and_totals(spark):
    r = random.Random(5)
    rows = [(i, texts(r, int(r.paretovariate(0.7) * 5), 3000), r.choice(["a", "b", "ß", "Z", "hot", "hot", "hot", None])) for i in range(1500)]
    rows += [(10_000 + i, t, s) for i, (t, s) in enumerate([("", "a"), (None, "b"), (" \n", None), (None, "none"), ("x " * 6_000, "hot"), ("one", "single")])]
    got, taken, want = check(spark, rows)
    for s, target in want.items():
        sizes = sorted((x.size for x in got if x.source == s), reverse=True)
        assert abs(taken[s] - target) <= min(sizes[0], max(sizes[0] if len(sizes) < 5 else 0.03 * float(target), 1)), (s, taken[s], float(target))
    again = mix(frame(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_draws_are_fair(spark):
    sizes, n = [1, 2, 2, 3, 5, 8, 40, 41, 90] + [4] * 80, 250
    rows = [(1000 * k + i, "w " * z, f"s{k:03}") for k in range(n) for i, z in enumerate(sizes)]
    got = mix(frame(spark, rows), weights=(1,), percent=130).collect()
    copies = Counter()
    for x in got:
        copies[x.doc_id % 1000] += x.copies
    sd = (0.3 * 0.7 / n) ** 0.5
    off = [(copies[i] / n - 1.3) / sd for i in range(len(sizes))]
    assert max(map(abs, off)) < 4.5 and abs(sum(off) / len(off)) < 0.5
    assert {x.copies for x in got} == {1, 2}


def test_repeated_rows_share_copies(spark):
    rows = [(1, "a b c", "s")] * 500 + [(None, "a b", "s")] * 7 + [(2, "a", "t")] * 3 + [(2, "a b", "t"), (2, "", "t"), (2, "a", None)]
    _, taken, want = check(spark, rows)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 3


def test_no_rows_and_no_words(spark):
    assert mix(frame(spark, [])).collect() == []
    got, _, _ = check(spark, [(1, None, "a"), (2, "", None), (3, " ", "a")])
    assert all(x.taken == 0 and x.target == 0 for x in got)


def test_very_long_text(spark):
    rows = [(0, "word " * 400_000, "a")] + [(i, "a b c", "a") for i in range(1, 50)]
    check(spark, rows)
