"""SentencePiece and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from layerroutes.llm._merges import LONGEST_ROW, Merges
from layerroutes.llm.packing import WordTokenizer, pack, shortest_pack_first
from layerroutes.llm.sentencepiece_bpe import encode_decode

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "hello world", "Hello, World!\n\nIt's 12,345.67 don't we'll", "\ttab\nline", "▁under ▁", "ünïcödé Straße ÉÉ", "日本語 テキスト", "😀 emoji 👩‍👩‍👧",
    "x" * 500, "ab" * 3000, "word " * 2000, "\x00nul\x1c\x85", "ﬁ ligature Å Å", "İstanbul ΑΣ", "<|endoftext|> and <s> </s> <unk> <0x41>", "a\xa0b　c", "ſ ŉ ß µ ª º ² ½", "'S 'T it's", "١٢٣", "$$$ ### %%% !!!",
]
SCHEMA = "doc_id long, text string, n long, ids string, rid int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", 3) for i, t in enumerate(texts)], SCHEMA)


def test_sentencepiece_matches_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in encode_decode(frame(spark, TEXTS).repartition(3), path, with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        assert got[i].ids == ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded == sp.decode(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encode_decode(frame(spark, []), path).count() == 0


def test_merges_alone_and_in_rows_agree():
    r = np.random.default_rng(3)
    left, right = r.integers(0, 12, 60), r.integers(0, 12, 60)
    m = Merges(left, right, r.permutation(60), r.integers(0, 12, 60))
    words = [r.integers(0, 6, r.integers(0, LONGEST_ROW)) for _ in range(400)]
    for w, got in zip(words, m.encode(words), strict=True):
        assert got.tolist() == m.alone(w).tolist()


def test_words_match_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    ours, theirs = WordTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    r = random.Random(2)
    texts += ["".join(r.choice("abcé'ſİst12 \n.,!$\x1c") for _ in range(60)) for _ in range(300)]
    for t, got in zip(texts, ours.batch(texts), strict=True):
        assert np.frombuffer(got, ours.kind).tolist() == theirs.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_token_once(seed):
    r = random.Random(seed)
    hist = {n: r.randint(1, 9) for n in r.sample(range(1, 65), r.randint(1, 40))}
    slots, packs = shortest_pack_first(hist, 64)
    total = sum(n * c for n, c in hist.items())
    assert packs == -(-total // 64)
    seen, room = {}, {}
    for length, r0, r1, start, n, first, offset in slots:
        for k in range(r0, r1):
            seen.setdefault((length, k), []).append((start, n))
            room.setdefault(first + k - r0, []).append((offset, n))
    assert sorted(seen) == sorted((n, k) for n, c in hist.items() for k in range(c))
    for cover, whole in [(v, k[0]) for k, v in seen.items()] + [(v, None) for v in room.values()]:
        at = 0
        for start, n in sorted(cover):
            assert start == at
            at += n
        assert at == whole if whole else at <= 64


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    texts = TEXTS + ["some words " * k for k in range(40)] + ["same text"] * 7
    rows = pack(frame(spark, texts).repartition(5), path, size=128, with_ids=True).collect()
    docs, seqs = {}, {}
    for x in rows:
        docs.setdefault(x.doc_id, []).append(x)
        seqs.setdefault(x.sequence_id, []).append(x)
        assert x.length == len(x.ids)
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        ids = []
        for x in sorted(docs[i], key=lambda x: x.start):
            assert x.start == len(ids)
            ids += x.ids
        assert ids == [*theirs.encode(t or "", add_special_tokens=False).ids, 1]
        assert {x.doc_tokens for x in docs[i]} == {len(ids)}
    fill = []
    for s in seqs.values():
        at = 0
        for x in sorted(s, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        fill.append(at)
    assert max(fill) <= 128
    assert sum(128 - f for f in fill) < 128
    assert sorted(seqs) == list(range(len(seqs)))
    assert pack(frame(spark, []), path).count() == 0
