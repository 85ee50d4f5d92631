"""The corpus pipeline: quality rules, quality classifier, exact dedup, near duplicates, packing.

Each stage works on all rows its predecessor kept. While a stage runs, a row is known by its
place in the files, so that null and repeated ids are no trouble. Of equal or
near-equal texts the row with the smallest doc_id stays; a null doc_id comes last, and of rows
with one doc_id the first stays. All stages but the last return the columns of their input,
whatever these are called besides; an empty table gives an empty result in each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerroutes.llm import exact_dedup, ngram_join, packing, quality_classifier, quality_rules
from layerroutes.llm._shared import Tables, new_path, table
from layerroutes.llm.queries import tokenizer_path


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _numbered(docs: DataFrame, stage: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, the same in every read: the place of a
    row in its file, which needs no copy. Rows that come from no file are stored with a number."""
    row = _free(docs, "_row")
    try:
        return docs.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), row
    except AnalysisException:
        return Tables(docs.sparkSession, stage).numbered(docs, row), row


def _kept(docs: DataFrame, stage: str, judge) -> DataFrame:
    """The rows of ``docs`` whose place is among ``judge(rows, name of the place)``."""
    rows, row = _numbered(docs, stage)
    kept = judge(rows, row).toDF(row)
    return rows.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject. Null and empty texts have too few words and go;
    repeated rows are judged alike."""
    return _kept(docs, "rules", lambda rows, row: quality_rules.quality_rules(rows, id_col=row).where("kept").select(row))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier predicts as bad. Labelled junk is gone from ``docs`` by now, so
    the model learns from all labelled documents of the input (a bounded sample). Repeated rows
    are judged alike, null and empty texts get the score of no difference."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    ident = _free(docs, "_doc")
    scored = quality_classifier.score(docs.withColumn(ident, F.col("doc_id")), model, id_col=ident, keep=tuple(docs.columns), prefix=_free(docs, "_made"))
    return scored.where(F.col(f"{_free(docs, '_made')}predicted") == 1).select(*docs.columns)


def _order(rows: DataFrame, row: str) -> tuple[DataFrame, str]:
    """``rows`` with an id that sorts by doc_id, null last, then by place."""
    name = _free(rows, "_id")
    return rows.withColumn(name, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col(row).alias("row"))), name


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, white space aside; null and empty texts are one text."""

    def judge(rows: DataFrame, row: str) -> DataFrame:
        rows, ident = _order(rows, row)
        return exact_dedup.exact_duplicates(rows, id_col=ident).where("kept").select(F.col(f"{ident}.row"))

    return _kept(docs, "exact", judge)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays, at the usual five words and a
    similarity of 0.8 (the query op6_ngram_join is fixed to four words and 0.85). Texts without
    words are linked with nothing and stay."""

    def judge(rows: DataFrame, row: str) -> DataFrame:
        rows, ident = _order(rows, row)
        found = ngram_join.near_duplicates(rows, id_col=ident)
        return found.where(F.col(f"{ident}.row") == F.col("component_id.row")).select(F.col(f"{ident}.row"))

    return _kept(docs, "near", judge)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; see ``packing.pack``."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("exact_dedup", exact), ("ngram_join", near), ("packing", packed)]

#: Compression, robust estimates and token ids are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
