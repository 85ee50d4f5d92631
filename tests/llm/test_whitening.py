"""Whitening against numpy over exact integers."""

import math

import numpy as np
import pytest

from layerroutes.llm.whitening import Centre, solved, whiten

SCHEMA = "vec_id long, embedding array<double>, component int, n string, x long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)


def valid(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def expected(rows, width):
    """Each step from its definition, sums as Python integers."""
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if valid(v) and len(v) == width]
    fit = sorted({x for _, x in kept})
    n, s = len(fit), [sum(x[d] for x in fit) for d in range(width)]
    c = np.array([[(n * x[d] - s[d]) / n for d in range(width)] for x in fit])
    e, v = np.linalg.eigh(c.T @ c / n)
    return kept, n, s, e[::-1], v[:, ::-1], np.trace(c.T @ c / n)


def check(spark, rows, width, top=16):
    kept, n, s, e, v, trace = expected(rows, width)
    got = whiten(frame(spark, rows)).collect()
    k = min(top, width)
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation)), {})[r.component] = r
    signs = {}
    assert got[0].n == n and got[0].identity_error < 1e-9
    for i, x in kept:
        d = [n * a - b for a, b in zip(x, s)]
        mine = by[i, sum(a * a for a in d)]
        for j in range(k):
            r = mine[j + 1]
            assert r.explained == pytest.approx(max(e[j], 0) / trace, rel=1e-9, abs=1e-15)
            want = float(np.dot(np.array(d, dtype=float) / n, v[:, j]) / math.sqrt(e[j]))
            if abs(want) > 1e-3:
                signs.setdefault(j, set()).add(r.whitened * want > 0)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-7)
    assert all(len(z) == 1 for z in signs.values())


def test_against_numpy(spark):
    g = np.random.default_rng(2)
    a = g.normal(size=(400, 20)) * (1.6 ** -np.arange(20)) @ np.linalg.qr(g.normal(size=(20, 20)))[0] * 40
    rows = [(i, v) for i, v in enumerate(a.tolist())]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(None, rows[4][1]), (7, rows[5][1])]
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [math.nan] * 20), (2003, rows[0][1][:-1] + [math.inf]), (2004, [1.0]), (2005, [])]
    check(spark, rows, 20)


def test_few_dimensions_and_far_apart_scales(spark):
    g = np.random.default_rng(3)
    a = g.normal(size=(300, 3)) * [1e6, 1.0, 30.0]
    check(spark, list(enumerate(a.tolist())), 3)


def test_components_without_variance(spark):
    g = np.random.default_rng(4)
    a = np.floor(g.normal(size=(200, 2)) * 200) / 64
    rows = [(i, [p, q, p + q, 5.0, p - q]) for i, (p, q) in enumerate(a.tolist())]
    got = whiten(frame(spark, rows)).collect()
    live = [r for r in got if r.component <= 2]
    assert len(got) == 1000 and all(r.whitened is not None for r in live)
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component > 2)
    assert got[0].identity_error < 1e-9 and sum(r.explained for r in live) == pytest.approx(200)


def test_one_vector_no_vectors_and_empty_ones(spark):
    got = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect()
    assert {(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    assert whiten(frame(spark, [])).collect() == [] and whiten(frame(spark, [(1, None)])).collect() == []
    assert whiten(frame(spark, [(1, []), (2, [])])).collect() == []


def test_entries_beyond_a_long(spark):
    got = whiten(frame(spark, [(1, [1e300, 1.0]), (2, [0.0, 2.0]), (3, [-5.0, 7.0])])).collect()
    x = [[2**61 + 1_000_000, 1_000_064], [1_000_000, 1_000_128], [999_680, 1_000_448]]
    s = [sum(r[d] for r in x) for d in (0, 1)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i + 1: sum((3 * a - b) ** 2 for a, b in zip(r, s)) for i, r in enumerate(x)}


def test_exact_sums_of_squares_and_solves():
    g = np.random.default_rng(5)
    x = g.integers(-(2**30), 2**30, size=(50, 90))
    c = Centre(2**28, [int(v) * 7 for v in g.integers(-(2**40), 2**40, 90)], 2**30)
    assert not c.wide
    assert c.deviation(x) == [sum((2**28 * int(a) - b) ** 2 for a, b in zip(r, c.sums)) for r in x]
    r = np.triu(g.normal(size=(130, 130))) + 20 * np.eye(130)
    y = g.normal(size=(10, 130))
    assert np.allclose(solved(y, r) @ r, y)
