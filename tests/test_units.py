"""Sentence ends and spans against plain Python."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from layerroutes.operators import units


def plain(text):
    tokens, end, ends = text.split(" "), -1, []
    for t in tokens:
        end += 1 + len(t)
        ends.append(end)
    valid = [i for i, t in enumerate(tokens) if t]
    out = {len(tokens)}
    for m in re.finditer(r"[.!?](?=\s|$)|[。！？]|\n+", text):
        at = bisect.bisect_left([ends[i] for i in valid], m.end())
        if at < len(valid):
            out.add(valid[at] + 1)
    return tokens, ends, sorted(out)


def texts():
    r = random.Random(2)
    return ["", ".", " . ", "One. Two!Three? Four.", "end.\n", "a\n\n\nb. ", "。x！ y？z", "no mark", "v1.2 is. out", "émile. 𝔘 x.", "  ", "a. \n b"] + ["".join(r.choice(["a", "b", " ", " ", ".", "!", "\n", "。", "\t"]) for _ in range(r.randint(1, 80))) for _ in range(80)]


def test_sentence_ends_and_spans(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, (999, None)], "doc_id long, text string").repartition(3)
    tokens = units.spaced_tokens(docs, "doc_id")
    got = {}
    for x in units.sentence_ends(docs, tokens, "doc_id").collect():
        got.setdefault(x.doc_id, []).append(x.token_end)
    made = {}
    for x in tokens.collect():
        made.setdefault(x.doc_id, []).append((x.pos, x.token, x.char_end))
    v = tokens.select("doc_id", "pos", F.array(F.length("token").cast("double"), F.col("pos").cast("double")).alias("x"))
    means = {(x.doc_id, x.token_end): (x.n, *x.x) for x in units.span_means(v, units.sentence_ends(docs, tokens, "doc_id"), "doc_id").collect()}
    for i, text in [*rows, (999, "")]:
        t, ends, want = plain(text)
        assert sorted(made[i]) == [(k + 1, a, e) for k, (a, e) in enumerate(zip(t, ends))]
        assert sorted(got[i]) == want, text
        for a, b in zip([0, *want], want):
            assert means[i, b] == pytest.approx((b - a, sum(map(len, t[a:b])) / (b - a), sum(range(a + 1, b + 1)) / (b - a)))


def test_last_vectors(spark):
    df = spark.createDataFrame([(1, 1, [1.0], True), (1, 2, [2.0], True), (1, 3, [3.0], False), (2, 1, [4.0], True)], "s int, pos int, x array<double>, prompt boolean")
    assert {(r.s, r.x[0]) for r in units.last_vectors(df, "s", "prompt").collect()} == {(1, 2.0), (2, 4.0)}
    assert {(r.s, r.x[0]) for r in units.last_vectors(df, "s").collect()} == {(1, 3.0), (2, 4.0)}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ends_and_spans_meet_each_row_of_a_text_once(spark):
    """A frame up to the end of the text is summed anew for each row: the square of a long text."""
    docs = spark.createDataFrame([(1, "a b. " * 3000)], "doc_id long, text string")
    tokens = units.spaced_tokens(docs, "doc_id")
    ends = units.sentence_ends(docs, tokens, "doc_id")
    spans = units.span_means(tokens.select("doc_id", "pos", F.array(F.lit(1.0)).alias("x")), ends, "doc_id")
    assert "unboundedfollowing" not in plan_of(spans).lower()
    assert spans.where("n = 2").count() == 3000


def test_token_units_split_a_text_once(spark, tmp_path):
    from layerroutes.plans.catalog import QUERIES

    rows = [(1, "a b  c"), (2, ""), (3, None), (4, "x " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["u05_token_units"](spark, str(tmp_path))
    assert "split(" not in plan_of(df).split("Generate")[0]
    got = sorted(tuple(x) for x in df.where("doc_id < 4").select("doc_id", "token_end", "n_tokens", "is_final").collect())
    assert got == [(1, 1, 4, False), (1, 2, 4, False), (1, 3, 4, False), (1, 4, 4, True), (2, 1, 1, True)]
    assert df.where("doc_id = 4 and n_tokens = 5001").count() == 5001
