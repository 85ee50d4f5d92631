"""Quality rules and the compression classifier."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from layerroutes.llm import quality_classifier as qc
from layerroutes.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, lang string, source string, key string, n long, distance int"
VOCAB = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def clean(r, n=80):
    return ".\n".join(" ".join(r.choice(VOCAB) + r.choice(VOCAB) for _ in range(10)) for _ in range(max(1, n // 10))) + "."


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def rows(r):
    texts = [None, "", "  \n ", "a b c", "a b c a b c", "ü é 日本 😀 $$", "x\nx\n\n\nx\r\nx", "w " * 300, "x" * 200_000, "a\x0bb\x0cc\x1cd"]
    texts += [clean(r, r.randint(50, 300)) for _ in range(1200)]
    junk = [" ".join(w.upper() + "%%%" for w in clean(r, 90).split()) for _ in range(60)]
    lines = ["the same line again and again here\n" + f"but one{k} more{k} thing{k} is{k} new{k}\n" for k in range(40)]
    junk += ["".join(lines[:k]) for k in range(20, 40)]
    return texts, junk


def test_rules_match_brute_force_counts_and_keep_clean(spark):
    r = random.Random(1)
    texts, junk = rows(r)
    data = [(i, t, r.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 5}", "k", 1, None) for i, t in enumerate(texts + junk)]
    data += [data[20], (None, data[20][1], None, None, None, None, None)]
    got = qr.quality_rules(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert len(got) == len(data)
    by = {x.doc_id: x for x in got}
    for i, t, *_ in data:
        c = counts(t)
        x = by[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == c
        assert x.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (x.kept and x.base_failed)
    assert all(by[i].kept for i in range(10, 10 + 1200))
    assert not any(by[i].kept for i in range(1210, 1210 + len(junk)))


def statistic_vectors(texts):
    x = []
    for t in texts:
        n, chars, sym, dup, rep = counts(t)
        lines = [y for y in t.split("\n") if y.strip()]
        up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
        x.append([np.log(1 + chars / n), np.log(1 + sym / n), dup / len(lines), rep / n, up / (up + low)])
    return np.array(x)


def least_determinant(x, rng):
    """Centre and scatter of just more than half of the rows with the least determinant among
    many random starts, each concentrated until nothing changes."""
    h, floors, best = len(x) // 2 + 1, np.diag(np.square(qr.FLOORS)), None
    shape = lambda rows: (rows.mean(0), np.cov(rows.T, bias=True) + floors)
    for _ in range(100):
        centre, cov = shape(x[rng.choice(len(x), 8, replace=False)])
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            new = shape(x[np.argsort(d, kind="stable")[:h]])
            if np.allclose(new[0], centre, atol=1e-12) and np.allclose(new[1], cov, atol=1e-12):
                break
            centre, cov = new
        if best is None or np.linalg.det(cov) < np.linalg.det(best[1]):
            best = centre, cov
    return best


@pytest.mark.parametrize("junk", [0, 40, 150])
def test_rules_distances_match_least_determinant_estimates(spark, junk):
    """The verdict's estimate against numpy: least determinant, then rows not rejected."""
    r = random.Random(4)
    texts = [clean(r, r.randint(50, 300)) for _ in range(400)] + [" ".join(w.upper() + "%%" for w in clean(r, 80).split()) for _ in range(junk)]
    got = {x.doc_id: x for x in qr.quality_rules(spark.createDataFrame([(i, t, "en", "s", "", 0, 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    x = statistic_vectors(texts)
    middle = lambda v: (np.floor(np.sort(v)[len(v) // 2] * 256) + 1) / 256
    far = lambda centre, cov: np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    d = far(*least_determinant(x, np.random.default_rng(junk)))
    inside, scale = np.ones(len(x), bool), None
    for _ in range(12):
        scale = max(1.0, np.expm1(middle(np.log1p(d[inside]))) / qr.MEDIAN)
        inside = d <= qr.CUT * scale
        d = far(x[inside].mean(0), np.cov(x[inside].T, bias=True) + np.diag(np.square(qr.FLOORS)))
    scale = max(1.0, np.expm1(middle(np.log1p(d[inside]))) / qr.MEDIAN)
    for i, row in got.items():
        assert row.base_failed or row.distance == pytest.approx(d[i] / scale, rel=0.03, abs=0.02), i
        assert row.base_failed or row.kept == (i < 400)


def test_rules_edges(spark):
    assert qr.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(i, clean(random.Random(i), 100), None, None, None, None, None) for i in range(3)]
    assert all(x.kept for x in qr.quality_rules(spark.createDataFrame(few, SCHEMA)).collect())


def test_rules_reject_junk_up_to_nearly_half_of_a_source(spark):
    r = random.Random(9)
    data, bad = [], set()
    for source, percent in (("a", 10), ("b", 30), ("c", 40), ("d", 45)):
        for k in range(300):
            text = clean(r, r.randint(50, 200))
            if 100 * k < 300 * percent:
                bad.add(len(data))
                text = " ".join(w.upper() + "%%%" for w in text.split())
            data.append((len(data), text, "en", source, "", 0, 0))
    got = qr.quality_rules(spark.createDataFrame(data, SCHEMA)).collect()
    assert {x.doc_id for x in got if not x.kept} == bad


def test_rules_judge_small_groups_by_their_own_rows(spark):
    r = random.Random(10)
    small = [(i, clean(r, 100), "en", "s", "", 0, 0) for i in range(20)]
    junk = [(20 + i, " ".join(w.upper() + "%%%" for w in clean(r, 100).split()), "en", "s", "", 0, 0) for i in range(6)]
    got = qr.quality_rules(spark.createDataFrame(small + junk, SCHEMA)).collect()
    assert {x.doc_id for x in got if not x.kept} == set(range(20, 26))
    # a rare language with far longer words, beside a large one
    many = [(100 + i, clean(r, 100), "en", "s", "", 0, 0) for i in range(300)]
    rare = [(i, " ".join("".join(r.choice(VOCAB) for _ in range(12)) for _ in range(80)), "fi", "s", "", 0, 0) for i in range(20)]
    got = qr.quality_rules(spark.createDataFrame(many + rare, SCHEMA)).collect()
    assert all(x.kept for x in got)


def test_classifier_learns_and_leaves_held_out_alone(spark):
    r = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        t = clean(r, r.randint(40, 300))
        docs.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t, "en", "s", "", 0, 0))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(bad) if held else int(not bad), 0))  # held-out labels are turned round
    docs += [(900, None, None, None, None, None, None), (901, "", "", "", "", 0, 0), (None, "x", "", "", "", 0, 0), (902, clean(r, 60) * 300, "", "", "", 0, 0), (902, "again", "", "", "", 0, 0)]
    docs_df, labels_df = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = qc.score(docs_df, qc.fit(docs_df, labels_df)).collect()
    assert len(got) == len(docs)
    for x in got:
        assert 0 <= x.score <= 1
        assert x.predicted == int(x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    right = [x.predicted == int(x.doc_id % 4 != 0) for x in got if x.doc_id is not None and x.doc_id < 900]
    assert sum(right) / len(right) > 0.97


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "a", "", "", "", 0, 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = qc.fit(docs, none)
    assert qc.score(docs, model).first().score is not None
    assert qc.score(docs.limit(0), model).count() == 0


def test_classifier_scores_match_brute_force(spark):
    """Sizes of every piece with both dictionaries, and the logistic curve, redone."""
    import zstandard

    r = random.Random(12)
    docs = [(i, clean(r, r.randint(20, 900)) if i % 2 else clean(r, r.randint(20, 300)).upper(), "en", "s", "", 0, 0) for i in range(300)] + [(300, None, "", "", "", 0, 0), (301, "", "", "", "", 0, 0), (302, "é日" * 5000, "", "", "", 0, 0)]
    frame = spark.createDataFrame(docs, SCHEMA)
    model = qc.fit(frame, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"))
    params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0)
    dicts = [zstandard.ZstdCompressionDict(raw) for raw in (model.good, model.bad)]
    for held in dicts:  # level 3 is set with the dictionary, digested once
        held.precompute_compress(level=3)
    tools = [zstandard.ZstdCompressor(dict_data=held, compression_params=params) for held in dicts]
    assert model.slope > 0
    got = {x.doc_id: x for x in qc.score(frame, model).collect()}
    for i, t, *_ in docs:
        raw = (t or "").encode()
        good, bad = (sum(len(tool.compress(raw[k : k + model.piece])) for k in range(0, len(raw), model.piece)) for tool in tools)
        x = (bad - good) / (bad + good) if raw else 0.0
        p = 1 / (1 + np.exp(-(model.slope * x + model.intercept)))
        assert abs(got[i].score - p) < 1e-9
        assert got[i].predicted == int(p >= 0.5)
