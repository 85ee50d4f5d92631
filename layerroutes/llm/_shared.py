"""What the corpus operators share: input columns, tables in the shared folder, and
connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where a local
    session has none (tests, a laptop) one is made and set; a cluster must name its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="layerroutes-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/layerroutes/{name}-{uuid.uuid4().hex}"


@contextmanager
def _clean_shuffles(spark: SparkSession):
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)


class Tables:
    """Tables that one call writes to the shared folder, to cut lineage and to read a costly
    step twice. Shuffle files of a write go when it ends; ``drop`` removes a table early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_path(spark, name), 0

    def store(self, df: DataFrame, name: str = "t", codec: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        with _clean_shuffles(self.spark):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._layerroutes_path = path
        return out

    def numbered(self, df: DataFrame, name: str = "rid") -> DataFrame:
        """``df`` with a number of its own for each row, stored, so that a row keeps its number
        whichever executors are lost or join. Zstandard, since texts are a table's bulk."""
        return self.store(df.withColumn(name, F.monotonically_increasing_id()), "input", "zstd")

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._layerroutes_path)
            path.getFileSystem(conf).delete(path, True)


def places(t: Tables, rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with pos, the place from 0 within ``group`` in ascending ``order`` (null first),
    and n, the size of the group; null is a group like any other. Rows are sorted in range
    partitions, which cut through a large group; a place is the place in the partition plus the
    rows of the group in the partitions before. The window is over one row a partition."""
    keys = [*group, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = t.store(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged", "zstd").withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("_c").over(w.orderBy("_part")) - F.col("_c")
    counts = counts.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_c").over(w).alias("n"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return ranged.join(t.store(counts, "counts"), same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``, both long: rows (node, comp) for every node
    of an edge between two different nodes, comp the smallest node reachable.

    Alternating large-star and small-star steps. Hubs only ever meet a ``min`` with map-side
    combine and joins that adaptive execution may split; no neighbour list is collected."""

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = tables.store(e, "edges")
    seen = stamp(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = tables.store(large, "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = tables.store(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "small")
        tables.drop(e, large)
        e, now = new, stamp(new)
        if now == seen:
            break
        seen = now
    lows = e.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(lows)
