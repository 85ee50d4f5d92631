"""Inputs of the queries: views over the given tables, as DataFrames and as SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerroutes.operators.cluster import lloyd_step
from layerroutes.operators.distances import nearest

LAYERS, WIDTH = 8, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark, d) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("row_id"), F.concat(F.lit("v"), v).alias("sample_id"), (F.col("label") % 2).cast("int").alias("label"),
        F.concat(F.lit("c"), F.col("label")).alias("category"), (1 + v % 5).cast("int").alias("level"), (16 + (v * 37) % 211).cast("int").alias("n_tokens"),
        F.when(v % 10 == 0, "length").otherwise("eos").alias("finish_reason"), "embedding",
    )


def states(spark, d) -> DataFrame:
    """Layer vectors: row_id, layer, x."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer"), "embedding")
    return e.select("row_id", "layer", F.slice("embedding", F.col("layer") * WIDTH + 1, WIDTH).cast("array<double>").alias("x"))


def centers(spark, d) -> DataFrame:
    """Frozen centres: 4 to 6 a layer."""
    return states(spark, d).where(F.col("row_id") < 4 + F.col("layer") % 3).select("layer", F.col("row_id").cast("int").alias("state"), F.col("x").alias("mu"))


def routes(spark, d) -> DataFrame:
    """row_id, layer, state (nearest frozen centre, lower id on ties), dist (squared)."""
    return nearest(states(spark, d), centers(spark, d)).select("row_id", "layer", "state", "dist")


def means(spark, d) -> DataFrame:
    """Centres learnt from all rows: the mean of the rows of each state."""
    return lloyd_step(states(spark, d), centers(spark, d)).select("layer", "state", "mu")


def rt(spark, d) -> DataFrame:
    return routes(spark, d).join(emb(spark, d).select("row_id", "label", "category", "level", "n_tokens", "finish_reason"), "row_id")


def evt(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("sample"), F.row_number().over(w).alias("token_end"), F.count("*").over(Window.partitionBy("user_id")).alias("n_tokens"),
        F.col("value").alias("score"), "event_id", (F.col("value") / 500).alias("entropy"), (-F.col("value") / 500).alias("logprob"),
        "event_type",
        F.concat(F.lit("g"), F.col("user_id") % 4).alias("category"), F.when((F.col("user_id") * 7919) % 3 > 0, 1).otherwise(0).alias("label"),
    ).withColumn("is_final", F.col("token_end") == F.col("n_tokens"))


def doc(spark, d) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = table(spark, d, "documents")
    return docs.join(labels, "doc_id").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("a"), "label", (1 + F.col("doc_id") % 5).cast("int").alias("level"))


def scan(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_linenumber").cast("int").alias("layer"), (2 + F.col("l_suppkey") % 12).cast("int").alias("k")).agg(
        F.round(F.avg("l_extendedprice"), 4).cast("double").alias("icl"), F.round(F.avg("l_discount"), 6).cast("double").alias("silhouette"), F.round(F.avg("l_tax") * 10, 6).cast("double").alias("stability")
    ).withColumn("converged", F.col("k") % 5 != 0)


_DIST = "list_sum(list_transform(list_zip(s.x, c.mu), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
SQL = {
    "emb": "SELECT vec_id AS row_id, 'v' || vec_id AS sample_id, (label % 2)::INT AS label, 'c' || label AS category, (1 + vec_id % 5)::INT AS level, (16 + (vec_id * 37) % 211)::INT AS n_tokens, CASE WHEN vec_id % 10 = 0 THEN 'length' ELSE 'eos' END AS finish_reason FROM embeddings",
    "states": "SELECT vec_id AS row_id, l::INT AS layer, embedding[l * 8 + 1 : l * 8 + 8]::DOUBLE[] AS x FROM embeddings, range(8) t(l)",
    "centers": "SELECT layer, row_id::INT AS state, x AS mu FROM states WHERE row_id < 4 + layer % 3",
    "routes": f"SELECT row_id, layer, state, dist FROM (SELECT s.row_id, s.layer, c.state, {_DIST} AS dist, row_number() OVER (PARTITION BY s.row_id, s.layer ORDER BY {_DIST}, c.state) AS i FROM states s JOIN centers c ON s.layer = c.layer) WHERE i = 1",
    "means": "SELECT layer, state, list(m ORDER BY i) AS mu FROM (SELECT layer, state, i, avg(x[i]) AS m FROM states JOIN routes USING (row_id, layer), range(1, 9) t(i) GROUP BY ALL) GROUP BY ALL",
    "rt": "SELECT routes.*, label, category, level, n_tokens, finish_reason FROM routes JOIN emb USING (row_id)",
    "evt": "SELECT user_id AS sample, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS token_end, count(*) OVER (PARTITION BY user_id) AS n_tokens, value AS score, event_id, value / 500 AS entropy, -value / 500 AS logprob, event_type, 'g' || (user_id % 4) AS category, CASE WHEN (user_id * 7919) % 3 > 0 THEN 1 ELSE 0 END AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = count(*) OVER (PARTITION BY user_id) AS is_final FROM events",
    "doc": "SELECT d.doc_id, text, lang, source, n_chars::DOUBLE AS a, quality::INT AS label, (1 + d.doc_id % 5)::INT AS level FROM documents d JOIN labels USING (doc_id)",
    "scan": "SELECT l_linenumber::INT AS layer, (2 + l_suppkey % 12)::INT AS k, round(avg(l_extendedprice), 4)::DOUBLE AS icl, round(avg(l_discount), 6)::DOUBLE AS silhouette, round(avg(l_tax) * 10, 6)::DOUBLE AS stability, (2 + l_suppkey % 12) % 5 <> 0 AS converged FROM lineitem GROUP BY ALL",
}
_NEEDS = {"centers": ["states"], "routes": ["states", "centers"], "rt": ["states", "centers", "routes", "emb"], "means": ["states", "centers", "routes"]}


def sql(body: str, *views: str) -> str:
    """``body`` after the views that it reads; ``body`` may go on with views of its own."""
    order: list[str] = []
    for v in views:
        order += [x for x in [*_NEEDS.get(v, []), v] if x not in order]
    return "WITH " + ", ".join(f"{v} AS MATERIALIZED ({SQL[v]})" for v in order) + (" " if body.lstrip().upper().startswith("SELECT") else ", ") + body


def uniform_sql(salt: str, ident: str) -> str:
    return f"(('0x' || substr(sha256('{salt}|' || ({ident})::VARCHAR), 1, 13))::BIGINT / pow(2::DOUBLE, 52))"
