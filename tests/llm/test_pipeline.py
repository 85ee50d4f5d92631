"""The pipeline's stages on a small table, against brute force."""

import re
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import brute_components
from tests.llm.test_quality import clean

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    base = [clean(r, r.randint(60, 200)) for _ in range(260)]
    texts = base + [base[3], base[3].replace(" ", "\n"), base[5]]
    for k in range(10, 20):
        w = base[k].split(" ")
        texts.append(" ".join([*w[:-1], "changed."]))
    texts += [" ".join(x.upper() + "%%%" for x in base[k].split()) for k in range(20, 40)] + [None, "", "too short"]
    ids = r.sample(range(10_000), len(texts))
    rows = [(i, t, None if k % 7 == 0 else "en", "hot" if k % 3 else "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not (t or "").isupper() and "%" not in (t or "")), 0) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({x.doc_id: x.text for x in docs.collect()})
    good = {i for (i, t, *_), (_, y, _) in zip(rows, labels, strict=True) if y and t and len(t.split()) >= 50}
    assert good == seen[0].keys() == seen[1].keys()  # nothing clean is lost, junk goes

    groups: dict[str, int] = {}
    for i, t in seen[1].items():
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        groups[n] = min(groups.get(n, i), i)
    assert seen[2].keys() == set(groups.values())

    left = sorted(seen[2].items())
    want = {c for _, _, c in brute_components([t for _, t in left], [i for i, _ in left], 5, 80)}
    assert seen[3].keys() == want

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in seen[3].items()}
    got: dict[int, int] = {}
    for x in docs.collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == tokens


def test_classifier_stage_decides(spark, tmp_path):
    """Junk that the rules before it would have let through goes; the stage learns from all
    labelled documents, not only from those that are left."""
    r = random.Random(5)
    good = [clean(r, r.randint(60, 200)) for _ in range(300)]
    junk = [" ".join(x.upper() + "%%%" for x in clean(r, r.randint(60, 200)).split()) for _ in range(300)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + junk)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)["quality_classifier"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for some in (docs, docs.where("doc_id < 300"), docs.where("doc_id >= 300")):
        assert {x.doc_id for x in stage(spark, some, str(tmp_path)).collect()} == {x.doc_id for x in some.collect() if x.doc_id < 300}


def test_stages_with_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, and columns called like those used inside."""
    r = random.Random(3)
    text, other = clean(r, 100), clean(r, 100)
    more = DOCS + ", _row long, _id string, _doc int, score double, predicted int, rid long, text_sha256 string"
    rows = [(i, t, "en", "s", 1, 5, "x", 7, 0.5, 0, 9, "y") for i, t in ((None, text), (5, text), (5, text), (3, other), (3, other), (None, None), (1, ""), (None, None))]
    for name, schema in (("documents", more), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows if name == "documents" else [], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    for where in ("file", "memory"):
        some = docs if where == "file" else spark.createDataFrame(rows, more)
        for name, want in (("exact_dedup", [(None, None), (3, other), (5, text)]), ("ngram_join", [(None, None), (None, None), (1, ""), (3, other), (5, text)])):
            got = stages[name](spark, some, str(tmp_path))
            assert got.columns == docs.columns
            if name == "exact_dedup":  # null and empty are one text; the row with an id stays
                want = [(1, ""), (3, other), (5, text)]
            assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == sorted(want, key=repr)
            assert all(x._row == 5 and x._id == "x" and x.rid == 9 for x in got.collect())
        assert sorted(x.doc_id or 0 for x in stages["quality_rules"](spark, some, str(tmp_path)).collect()) == [0, 3, 3, 5, 5]
        assert stages["quality_classifier"](spark, some, str(tmp_path)).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id = 77"), str(tmp_path)).count() == 0, name
