"""Ranks, quantiles and nulls over groups of any size."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerroutes.functions import stats
from layerroutes.operators import nulls


def parts_of(df):
    """Rows of each window part of a plan of ``running``, by its own cut."""
    seen = df.sparkSession.createDataFrame(df.select("v").collect(), "v double")
    ends = [seen.agg(F.min("v")).first()[0], *seen.agg(F.percentile_approx("v", [i / 32 for i in range(1, 32)], 1000)).first()[0], seen.agg(F.max("v")).first()[0]]
    out = Counter()
    for (v,) in seen.collect():
        q = sum(c < v for c in ends[1:-1])
        lo, hi = ends[q], ends[q + 1]
        out[q, min(int((v - lo) / (hi - lo) * 32), 31) if hi > lo else 0] += 1
    return out


@pytest.mark.parametrize("far", [1e12, -1e300, 0.0])
def test_running_sums_with_an_outlier(spark, far):
    r = random.Random(1)
    values = [r.random() for _ in range(3000)] + [far]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, one int").repartition(4)
    got = {x.v: x.n for x in stats.running(df, [], "v", {"n": "one"}).collect()}
    order = sorted(values)
    assert all(got[v] == i + 1 for i, v in enumerate(order))
    assert max(parts_of(df).values()) < 400


def test_places_in_one_group_of_all_rows(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), "id").repartition(5)
    got = stats.place(df, ["g"], F.xxhash64("id"), "at").collect()
    assert sorted(x["at"] for x in got) == list(range(1, 2001))


def test_quantiles(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1000), ("b", 7), ("c", 1)) for v in np.round(r.normal(size=n), 2)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for x in stats.quantiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect():
        own = [v for g, v in rows if g == x.g and v is not None]
        assert [x[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(own, [0, 0.05, 0.5, 0.95, 1]))
    assert stats.quantiles(df, [], "v", [0.5]).first()[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def ami(a, b):
    """From the definition, chances as exact fractions of binomials."""
    n, x, y, m = len(a), Counter(a), Counter(b), Counter(zip(a, b))
    mi = sum(c / n * math.log(n * c / (x[p] * y[q])) for (p, q), c in m.items())
    e = 0.0
    for p in x.values():
        for q in y.values():
            for k in range(max(1, p + q - n), min(p, q) + 1):
                e += math.comb(q, k) * math.comb(n - q, p - k) / math.comb(n, p) * k / n * math.log(n * k / (p * q))
    h = [-sum(c / n * math.log(c / n) for c in z.values()) for z in (x, y)]
    return mi, e, (mi - e) / (sum(h) / 2 - e)


@pytest.mark.parametrize("n,ka,kb", [(60, 3, 4), (500, 2, 2), (40, 15, 20)])
def test_adjusted_information(spark, n, ka, kb):
    r = random.Random(n)
    rows = [(g, r.randrange(ka), r.randrange(kb)) for g in "pq" for _ in range(n)]
    rows = [(g, a, a % kb if r.random() < 0.4 else b) for g, a, b in rows]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    for x in stats.adjusted_information(df, "a", "b", ["g"]).collect():
        own = [(a, b) for g, a, b in rows if g == x.g]
        assert (x.mi, x.expected, x.ami) == pytest.approx(ami(*zip(*own)), rel=1e-8)
    whole = stats.adjusted_information(df, "a", "b").first()
    assert whole.ami == pytest.approx(ami([a for _, a, _ in rows], [b for _, _, b in rows])[2], rel=1e-8)


def test_adjusted_information_of_trivial_labellings(spark):
    df = spark.createDataFrame([(i, 0, 0, i % 2) for i in range(6)], "i int, a int, b int, c int")
    assert stats.adjusted_information(df, "a", "b").first().ami == 1.0
    assert stats.adjusted_information(df, "i", "i").first().ami == 1.0
    assert stats.adjusted_information(df, "a", "c").first().ami == 0.0


def test_suffix_exchange_keeps_edges_and_folds(spark):
    r = random.Random(9)
    z = {i: [r.randrange(3) for _ in range(6)] for i in range(400)}
    routes = spark.createDataFrame([(i, layer, s) for i, v in z.items() for layer, s in enumerate(v)], "row_id long, layer int, state int")
    folds = spark.createDataFrame([(i, i % 2) for i in z], "row_id long, fold int")
    got = {}
    for x in nulls.suffixes_exchanged(routes, folds, "test").collect():
        got.setdefault(x.row_id, {})[x.layer] = x.state
    assert got.keys() == z.keys()

    def edges(of, fold):
        return Counter((layer, of[i][layer], of[i][layer + 1]) for i in z if i % 2 == fold for layer in range(5))

    for fold in (0, 1):
        assert edges(got, fold) == edges(z, fold)
    moved = sum(got[i][5] != z[i][5] for i in z)
    assert moved > 150 and all(got[i][0] == z[i][0] and got[i][1] == z[i][1] for i in z)
    again = {(x.row_id, x.layer): x.state for x in nulls.suffixes_exchanged(routes.repartition(7), folds, "test").collect()}
    assert all(again[i, k] == v for i, g in got.items() for k, v in g.items())


def test_adjusted_information_of_millions_of_rows(spark):
    """Products of four counts pass the range of long numbers."""
    cells = [("a", "x", 1_500_000), ("a", "y", 1_500_000), ("b", "x", 1_000_000), ("b", "y", 2_000_000)]
    df = spark.createDataFrame(cells, "a string, b string, n int").select("a", "b", F.explode(F.sequence(F.lit(1), "n")))
    row = stats.adjusted_information(df, "a", "b").first()
    n = 6e6
    mi = sum(m / n * math.log(m * n / (3e6 * y)) for m, y in ((1.5e6, 2.5e6), (1.5e6, 3.5e6), (1e6, 2.5e6), (2e6, 3.5e6)))
    assert row.mi == pytest.approx(mi, rel=1e-9)
    assert row.expected == pytest.approx(1 / (2 * n), rel=1e-3)  # (rows - 1)(columns - 1) / 2n


def test_running_cuts_are_drawn_once(spark):
    """Approximate quantiles depend on the order in which parts arrive, so a plan that draws them
    for the offsets and again for the rows may cut differently and sum wrongly."""
    df = spark.range(5000).select((F.xxhash64("id") % 997).cast("double").alias("v"), F.lit(1).alias("one"), (F.col("id") % 2).alias("g"))
    for by in ([], ["g"]):
        plan = stats.running(df, by, "v", {"n": "one"})._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile_approx" not in plan


def test_terms_of_a_text_are_counted_where_the_text_is(spark, tmp_path):
    """Texts are shuffled by id; their terms, several times as large, are not."""
    from layerroutes.plans.catalog import QUERIES

    rows = [(i, "one two one " + "x" * (i % 3)) for i in range(20)] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["l22_tfidf"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert by and not any(b.startswith("doc_id") and "term#" in b.split(")")[0] for b in by)
    assert df.where("term = 'one'").count() == 20
