"""Sources and sinks: validated scans, layer matrices and trial tables as partitioned Parquet."""

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerroutes.functions.hashing import uniform
from layerroutes.sources import digests


def layer_ids(asked: list[int], n_layers: int) -> list[int]:
    """Layer ids from the asked ones; negative ones count from the end."""
    ids = [k + n_layers if k < 0 else k for k in asked]
    if any(not 0 <= k < n_layers for k in ids) or len(set(ids)) != len(ids):
        raise ValueError(f"layers {asked} of {n_layers}")
    return ids


def with_labels(samples: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Left join of binary labels; a repeated key or another value is an error at run time."""
    bad = F.raise_error(F.lit("labels must be unique, and 0, 1 or null")).cast("int")
    one = labels.groupBy(key).agg(F.count("*").alias("_n"), F.max(label).alias(label))
    checked = one.select(key, F.when((F.col("_n") > 1) | ~F.coalesce(F.col(label), F.lit(0)).isin(0, 1), bad).otherwise(F.col(label).cast("int")).alias(label))
    return samples.join(checked, key, "left")


def coalesced_label(rows: DataFrame, names: tuple[str, ...] = ("is_correct", "label")) -> Column:
    """The first of the columns ``names`` that ``rows`` has, as 0 or 1; null, or no such column, is 0."""
    found = next((c for c in names if c in rows.columns), None)
    return F.lit(0) if found is None else F.coalesce(F.col(found).cast("int"), F.lit(0))


def selection(rows: DataFrame, order: str, item_ids=None, item: str = "item_id", sample_ids=None, sample: str = "sample_id", predicate: str | None = None, frac: float | None = None, seed: str = "select", head: int | None = None, tail: int | None = None) -> DataFrame:
    """Rows chosen, in this order, by item ids, sample ids, a predicate, a hash share of ``order``,
    the first ``head`` and then the last ``tail`` rows by ``order``. Ids are a list or a frame
    of one column, which is joined, so that it may be of any length."""
    for ids, c in ((item_ids, item), (sample_ids, sample)):
        if isinstance(ids, DataFrame):
            rows = rows.join(ids.toDF(c), c, "left_semi")
        elif ids is not None:
            rows = rows.where(F.col(c).isin(list(ids)))
    if predicate:
        rows = rows.where(predicate)
    if frac is not None:
        rows = rows.where(uniform(seed, F.col(order)) < frac)
    if head is not None:
        rows = rows.orderBy(order).limit(head)
    return rows if tail is None else rows.orderBy(F.desc(order)).limit(tail)


def violations(units: DataFrame) -> DataFrame:
    """Counts per rule of the row contract: ids, token_end within 1 and n_tokens, one row per
    unit, one n_tokens per sample, boundaries that rise and end at n_tokens."""
    per = units.groupBy("sample").agg(F.countDistinct("n_tokens").alias("k"), F.max("token_end").alias("last"), F.max("n_tokens").alias("n"), F.count("*").alias("rows"), F.countDistinct("token_end").alias("ends"))
    a = units.agg(
        F.count(F.when(F.col("sample").isNull() | (F.col("sample").cast("string") == ""), 1)).alias("empty_id"), F.count(F.when(~F.col("token_end").between(1, F.col("n_tokens")), 1)).alias("range"),
    )
    b = per.agg(F.coalesce(F.sum(F.col("rows") - F.col("ends")), F.lit(0)).alias("repeated"), F.count(F.when(F.col("k") > 1, 1)).alias("n_tokens"), F.count(F.when(F.col("last") != F.col("n"), 1)).alias("not_final"))
    return a.join(b).unpivot([], ["empty_id", "range", "repeated", "n_tokens", "not_final"], "rule", "n")


def keep_last(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("_i = 1").drop("_i")


def write_states(states: DataFrame, path: str) -> None:
    """Layer vectors partitioned by layer; vectors of other widths or not finite fail."""
    width = states.groupBy("layer").agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b"), F.max(F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))).cast("int")).alias("odd"))
    if not width.where("a <> b or odd = 1").isEmpty():
        raise ValueError("layer vectors must be finite and of one width a layer")
    states.repartition("layer", F.pmod(F.xxhash64("row_id"), F.lit(32))).write.partitionBy("layer").parquet(path)


def read_states(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if layers is None else df.where(F.col("layer").isin(layers))


FORMAT = 1
REPRESENTATIONS = ("mean", "prompt_last", "tokens", "prefix", "sentence")


def export_arrays(states: DataFrame, path: str, model: tuple[str, str], representation: str = "mean", final_norm: str = "post", dataset_id: str | None = None) -> None:
    """An interchange data set: layer vectors under ``path/states`` and a manifest, one JSON row,
    under ``path/manifest``. Every layer must have the same rows and width; the manifest names
    the model and its pinned revision and is written last, so that it marks a whole data set."""
    if len(model) != 2 or not all(model):
        raise ValueError("model must be an identifier and a pinned revision")
    if representation not in REPRESENTATIONS or final_norm not in ("pre", "post"):
        raise ValueError(f"no such representation: {representation}, {final_norm}")
    write_states(states, f"{path}/states")
    spark = states.sparkSession
    per = spark.read.parquet(f"{path}/states").groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.sum(F.xxhash64("row_id").cast("decimal(38,0)")).alias("which"), F.max(F.size("x")).alias("width")).orderBy("layer").collect()  # a row a layer
    if not per or len({(r.n, r.ids, r.which, r.width) for r in per}) > 1 or per[0].n != per[0].ids:
        raise ValueError("all layers must have the same rows, each once, and one width")
    body = {"format_version": FORMAT, "model": list(model), "layers": [r.layer for r in per], "rows": per[0].n, "width": per[0].width, "representation": representation, "final_norm": final_norm, "dataset_id": dataset_id}
    spark.createDataFrame([(json.dumps(body),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")


def open_arrays(spark: SparkSession, path: str, layers: list[int] | None = None, model: tuple[str, str] | None = None) -> tuple[DataFrame, dict]:
    """The vectors of a data set and its manifest. Another format, a missing layer (negative ones
    count from the last), or another model than the one asked for is an error."""
    found = spark.read.text(f"{path}/manifest").collect()  # one row
    if len(found) != 1:
        raise ValueError("a data set has one manifest")
    body = json.loads(found[0][0])
    if body.get("format_version") != FORMAT:
        raise ValueError(f"format {body.get('format_version')} is not {FORMAT}")
    if model is not None and list(model) != body["model"]:
        raise ValueError(f"model {body['model']} is not {list(model)}")
    have, asked = body["layers"], layers
    if layers is not None:
        asked = [have[k] if k < 0 and -k <= len(have) else k for k in layers]
        if not set(asked) <= set(have) or len(set(asked)) != len(asked):
            raise ValueError(f"layers {layers} of {have}")
    return read_states(spark, f"{path}/states", asked), body


def same_source(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, problem) of data sets that cannot be read as one: another model signature, layers,
    width or representation than the first, or row ids that an earlier one has."""
    bodies = {p: open_arrays(spark, p)[1] for p in paths}
    first, out = bodies[paths[0]], []
    for p, b in bodies.items():
        out += [(p, k) for k in ("model", "layers", "width", "representation", "final_norm") if b[k] != first[k]]
    ids = [spark.read.parquet(f"{p}/states").where(F.col("layer") == bodies[p]["layers"][0]).select("row_id", F.lit(i).alias("i")) for i, p in enumerate(paths)]
    every = ids[0]
    for x in ids[1:]:
        every = every.unionByName(x)
    names = F.element_at(F.array(*map(F.lit, paths)), F.col("i") + 1)
    w = Window.partitionBy("row_id")
    twice = every.withColumn("least", F.min("i").over(w)).where("i > least").groupBy("i").agg(F.count("*").alias("n")).select(names.alias("path"), F.concat(F.lit("row_id of another: "), F.col("n")).alias("problem"))
    return spark.createDataFrame(out, "path string, problem string").unionByName(twice)


def inventory(spark: SparkSession, path: str, piece: int = 128 << 20) -> DataFrame:
    """(name, bytes, sha256) of all files below ``path`` that Spark's readers see: not empty ones,
    nor those named with a leading underscore or dot. A file of up to ``piece`` bytes is read
    whole by one task, a larger one in pieces; but one named as compressed (.gz and the like) is
    read whole, up to Spark's limit of 2 GB, since Spark's text reader would unpack it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = {r.file_path: (r.path, r.length) for r in files.where(F.col("length") > piece).select("_metadata.file_path", "path", "length").collect()}  # a row a large file
    packed = [p for p, _ in large.values() if re.search(r"\.(gz|bz2|zst|lz4|snappy|deflate|passthrough)$", p)]
    cut = {k: f for k, f in large.items() if f[0] not in packed}
    whole = files.where(F.col("length") <= piece)
    if packed:
        whole = whole.unionByName(spark.read.format("binaryFile").load([digests.plain(p) for p in packed]))
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    out = whole.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if cut:
        found = digests.sha256(spark, cut, piece)
        rows = spark.createDataFrame([(p, n, found[k]) for k, (p, n) in cut.items()], "path string, bytes long, sha256 string")
        out = out.unionByName(rows.select(name, "bytes", "sha256"))
    return out


def write_trial(tables: dict[str, DataFrame], path: str, trial_id: str) -> None:
    for name, df in tables.items():
        df.withColumn("trial_id", F.lit(trial_id)).write.mode("append").partitionBy("trial_id").parquet(f"{path}/{name}")


def collect_trials(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def view_columns(samples: DataFrame, prefix: str = "sample__") -> list[Column]:
    """Numeric sample columns under a prefix."""
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [F.col(c).alias(prefix + c) for c, t in samples.dtypes if t in kinds]


def discover(spark, pattern: str, marker: str = "_SUCCESS", drop: tuple[str, ...] = ("incoming", "failed"), most: int | None = None) -> list[str]:
    """Finished shards: folders matching ``pattern`` that hold the marker file and are not named
    as on their way or failed; sorted, at most ``most``. Listed through Hadoop's file systems,
    since Spark's readers hide files with a leading underscore and empty ones."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern.rstrip("/") + "/" + marker)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    shards = sorted(f.getPath().getParent().toString() for f in found if f.isFile())
    return [s for s in shards if s.rsplit("/", 1)[1] not in drop][:most]
