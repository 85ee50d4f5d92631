"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerroutes.llm import exact_dedup, html_text, licenses, merkle, mixing, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_bpe, sharding, warc, whitening
from layerroutes.llm._shared import table

SHARD_BYTES = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies under its source, language and block of 64 ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs, path)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("distance")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null here."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf proved; where 5 divides the CRC-32 of the id, the text was lower-cased since."""
    docs, name = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    fields = [F.col(f) for f in merkle.FIELDS]
    lower = F.translate("text", _UPPER, _UPPER.lower())
    now = F.when(F.crc32(name.cast("binary")) % 5 == 0, merkle.digest(*fields[:-1], lower)).otherwise(merkle.digest(*fields))
    found = merkle.manifest(docs, keep={"now": now})
    folded = found.withColumn("folded_root", merkle.fold(F.col("now"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_sentencepiece, op3_licenses, op4_quality_classifier, op5_exact_dedup, op6_ngram_join, op7_packing, op8_html_text, op9_sharding, op10_quality_rules, op11_whitening, op12_mixing, op13_merkle, pipeline)}

_LETTERS = f"'{_UPPER}', '{_UPPER.lower()}'"

ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) || '0' AS x, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   (((('0x' || substr(x, (5 * i // 4 + 1)::BIGINT, 2))::BIGINT >> (3 - (5 * i) % 4)::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d""",
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
    "op6_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
   ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
 n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
 e AS (SELECT doc_id, unnest(sh) AS t FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 reach(d, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT d, y FROM reach JOIN both_ways ON r = x)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach ON d = n.doc_id GROUP BY n.doc_id, n.n""",
    "op9_sharding": f"""
WITH h AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
 d AS (SELECT doc_id, n_bytes, k::INT AS depth, h >> (52 - k)::BIGINT AS shard FROM h, range(0, 53) r(k)),
 z AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes FROM d GROUP BY ALL),
 f AS (SELECT d.*, z.shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY d.depth) AS i FROM d JOIN z USING (depth, shard) WHERE shard_bytes <= {SHARD_BYTES} OR d.depth = 52)
SELECT doc_id, depth, shard, 0::BIGINT AS part, n_bytes, shard_bytes FROM f WHERE i = 1""",
    "op13_merkle": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
   text, translate(text, {_LETTERS}) AS low, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
   lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 5 = 0, false) AS changed FROM documents),
 leaf AS MATERIALIZED (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || CASE WHEN changed THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS now FROM d),
 place AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaf),
 tree(g, lev, pos, n, h) AS (SELECT g, 0, pos, count(*) OVER (PARTITION BY g), h FROM place
   UNION ALL SELECT g, min(lev) + 1, pos // 16, (min(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, pos // 16),
 sub AS MATERIALIZED (SELECT g, lev, h FROM tree WHERE n = 1),
 top(lev, pos, n, h) AS (SELECT 0, g, count(*) OVER (), h FROM sub
   UNION ALL SELECT min(lev) + 1, pos // 16, (min(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 16),
 root AS (SELECT h FROM top WHERE n = 1),
 node AS MATERIALIZED (SELECT g, lev, pos, pos // 16 AS run, h FROM tree WHERE n > 1),
 part AS MATERIALIZED (SELECT g, lev, run, list(h ORDER BY pos) AS hs FROM node GROUP BY ALL),
 over AS MATERIALIZED (SELECT lev, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
 steps AS (SELECT p.g, p.pos AS leaf, part.lev, ((p.pos // (16 ** part.lev)::BIGINT) % 16)::BIGINT AS k, hs FROM place p JOIN part ON part.g = p.g AND part.run = p.pos // (16 ** (part.lev + 1))::BIGINT
   UNION ALL SELECT p.g, p.pos, 1000 + over.lev, ((p.g // (16 ** over.lev)::BIGINT) % 16)::BIGINT, hs FROM place p JOIN over ON over.run = p.g // (16 ** (over.lev + 1))::BIGINT),
 flank AS (SELECT g, leaf, list({{'l': array_to_string(hs[1:k], ''), 'r': array_to_string(hs[k + 2:16], '')}} ORDER BY lev) AS f FROM steps GROUP BY g, leaf),
 proof AS (SELECT p.doc_id, p.h, sub.h AS subroot, root.h AS root, p.now, coalesce(f, []) AS f FROM place p JOIN sub ON sub.g = p.g CROSS JOIN root LEFT JOIN flank ON flank.g = p.g AND flank.leaf = p.pos),
 done AS (SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(f, lambda x: x.l || x.r), '')) AS proof_sha256,
   list_reduce(list_prepend({{'l': now, 'r': ''}}, f), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root FROM proof)
SELECT *, folded_root = root AS verified FROM done""",
}
