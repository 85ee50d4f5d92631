"""Operators against direct computations on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerroutes.functions.hashing import fold
from layerroutes.functions.stats import auroc, running
from layerroutes.operators import align, cluster, monitor, nulls, routes
from layerroutes.sources import tables as S


@pytest.mark.parametrize("seed", range(12))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 6), r.integers(1, 6)
    cost = r.integers(-9, 9, (n, m)).astype(float)
    pairs = align.assignment(cost)
    small, large = sorted((n, m))
    c = cost if n <= m else cost.T
    best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), int(small)))
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == small
    assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_running_sum_over_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), k * r.random() ** 9, 1.0) for k in range(1, 300)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    for down in (False, True):
        for g, v, _, s in running(df, ["g"], "v", {"s": "w"}, descending=down).select("g", "v", "w", "s").collect():
            assert s == sum(1 for a, b, _ in rows if a == g and (b >= v if down else b <= v))
    assert running(df.where("false"), [], "v", {"s": "w"}).count() == 0


def test_auroc_counts_ties_half(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 9), r.randint(0, 1)) for _ in range(200)]
    got = auroc(spark.createDataFrame(rows, "s int, y int"), "s", "y").first().auroc
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert auroc(spark.createDataFrame([(1, 1)], "s int, y int"), "s", "y").first().auroc is None


def test_fold_is_the_whole_digest(spark):
    import hashlib

    for k in (2, 5, 97):
        for r in spark.range(20).select("id", fold("s", F.col("id"), k).alias("f")).collect():
            assert r.f == int(hashlib.sha256(f"s:{r.id}".encode()).hexdigest(), 16) % k


def test_kmeans_inertia_falls(spark):
    r = np.random.default_rng(0)
    rows = [(i, i % 2, (r.normal(size=3) + 5 * (i % 3)).tolist()) for i in range(120)]
    states = spark.createDataFrame(rows, "row_id long, layer int, x array<double>")
    start = spark.createDataFrame([(layer, k, rows[layer + 2 * k][2]) for layer in (0, 1) for k in range(3)], "layer int, state int, mu array<double>")
    _, history = cluster.kmeans(states, start, 6)
    assert all(b <= a + 1e-9 for a, b in zip(history, history[1:], strict=False))


def test_far_threshold_counts_responses_without_boundary(spark):
    rows = [(s, 1, 2, False, 1, float(s)) for s in range(9)] + [(9, 1, 1, True, 1, 99.0)]
    b = spark.createDataFrame(rows, "sample int, token_end int, n_tokens int, is_final boolean, label int, score double")
    assert monitor.far_threshold(b, 0.2, final=False).first().threshold == 6.0
    assert monitor.far_threshold(b, 0.0, final=False).first().threshold == 8.0
    assert monitor.far_threshold(b, 0.1).first().threshold == 8.0


def test_events_of_states(spark):
    r = spark.createDataFrame([(i, layer, s, 1) for i in range(3) for layer, s in enumerate([(0, 0, 0), (0, 1, 1), (0, 1, -1)][i])], "row_id int, layer int, state int, label int")
    e = {(x.layer_from, x.state_from, x.state_to): x.n for x in routes.transitions(r).collect()}
    assert e == {(0, 0, 0): 1, (0, 0, 1): 2, (1, 0, 0): 1, (1, 1, 1): 1}


def test_layer_ids_and_label_contract(spark):
    assert S.layer_ids([0, -1], 4) == [0, 3]
    for bad in ([0, -4], [4]):
        with pytest.raises(ValueError):
            S.layer_ids(bad, 4)
    samples, labels = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 1), (1, 0)], "k int, y int")
    with pytest.raises(Exception, match="labels must be unique"):
        S.with_labels(samples, labels, "k", "y").collect()


def test_states_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(8)], "row_id long, layer int, x array<double>")
    S.write_states(df, str(tmp_path / "s"))
    assert S.read_states(spark, str(tmp_path / "s"), [1]).count() == 4
    with pytest.raises(ValueError):
        S.write_states(df.union(spark.createDataFrame([(9, 1, [1.0])], df.schema)), str(tmp_path / "t"))


def test_births_and_deaths_by_hand(spark):
    r = spark.createDataFrame([(i, layer, s, 1) for i in range(30) for layer, s in enumerate((0, 0, 5, 5))], "row_id int, layer int, state int, label int")
    got = {tuple(x) for x in routes.births_deaths(routes.transitions(r)).collect()}
    assert got == {("birth", 2, 5, 30), ("death", 1, 0, 30)}
    assert routes.births_deaths(routes.transitions(r), 31).count() == 0


def test_alarm_scope_keeps_the_false_alarm_rate(spark):
    """Non-final scores of 20 successes are 0 to 19, their final ones 100: calibrated without
    final boundaries, at most a tenth may alarm."""
    rows = [(s, 1, 2, False, 1, float(s)) for s in range(20)] + [(s, 2, 2, True, 1, 100.0) for s in range(20)] + [(99, 1, 1, True, 1, -5.0)]
    b = spark.createDataFrame(rows, "sample int, token_end int, n_tokens int, is_final boolean, label int, score double")
    for final in (True, False):
        th = monitor.far_threshold(b, 0.1, final=final)
        assert monitor.metrics(monitor.cases(b.join(th), F.col("threshold"), final=final)).first().far <= 0.1
    assert monitor.far_threshold(b.where("sample = 99"), 0.1, final=False).first().threshold < -5.0


def test_matching_tests_the_raw_similarity(spark):
    s = spark.createDataFrame([(1, 0, 0, -0.4), (1, 0, 1, -0.6)], "layer int, a int, b int, sim double")
    assert align.optimal(s, 0.0).count() == 0
    assert [tuple(x)[1:3] for x in align.optimal(s, -0.5, allow_negative=True).collect()] == [(0, 0)]


def test_alignment_over_chosen_layers(spark):
    c = spark.createDataFrame([(layer, k, [float(k), 1.0 - k]) for layer in (0, 8, 16) for k in (0, 1)], "layer int, state int, mu array<double>")
    got = {tuple(x) for x in align.align_layers(c, align.greedy(align.similarities(c), ["layer"], 0.5)).collect()}
    assert got == {(layer, k, k) for layer in (0, 8, 16) for k in (0, 1)}


def steps_frame(spark, seed, n=400):
    r = random.Random(seed)
    rows = [(i, r.randint(0, 1), r.randint(0, 2), r.randint(0, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, label int, i int, dest int"), rows


def test_permutations_keep_groups_and_counts(spark):
    df, rows = steps_frame(spark, 3)
    p = nulls.permuted_labels(df, ["i"], "row_id", 4, "x")
    want = {(i, sum(y for _, y, k, _ in rows if k == i)) for i in range(3)}
    for rep in range(4):
        assert {tuple(x) for x in p.where(F.col("rep") == rep).groupBy("i").agg(F.sum("label")).collect()} == want
    s = nulls.shuffled(df, ["i"], "row_id", "dest", "y")
    count = lambda f: {tuple(x) for x in f.groupBy("i", "dest").count().collect()}
    assert count(s) == count(df)
    assert s.count() == df.count()


def test_exact_mean_is_the_mean_of_permutations(spark):
    """Over all ways to deal three ones to six rows."""
    dest = [0, 0, 0, 1, 1, 2]
    rows = [(k, i, int(i in ones), d) for k, ones in enumerate(itertools.combinations(range(6), 3)) for i, d in enumerate(dest)]
    df = spark.createDataFrame([(a, 0, y, d) for a, _, y, d in rows], "rep int, g int, label int, dest int")
    mean = nulls.conditional_js(df, ["rep"], ["g"]).agg(F.avg("js")).first()[0]
    assert nulls.exact_mean(df.where("rep = 0"), ["rep"], ["g"]).first()["mean"] == pytest.approx(mean)


def test_log_factorial(spark):
    import math

    for x in spark.createDataFrame([(n,) for n in (0, 1, 5, 20, 21, 100, 10**6)], "n long").select("n", nulls.log_factorial(F.col("n")).alias("v")).collect():
        assert x.v == pytest.approx(math.lgamma(x.n + 1), rel=1e-12, abs=1e-12)
