"""Queries of whole routes: neighbours, latent classes, exchanges."""

from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.functions.hashing import uniform
from layerroutes.operators import latent, neighbours, nulls
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql, uniform_sql
from layerroutes.plans.registry import query

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
TRAIN, TEST = "row_id % 5 <> 0", "row_id % 5 = 0"
K = 35

_LOF = f"""p AS MATERIALIZED (SELECT row_id, list(state ORDER BY layer) AS z FROM routes GROUP BY row_id),
 pairs AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, sqrt(2.0 * len(list_filter(list_zip(a.z, b.z), lambda x: x[1] <> x[2]))) AS d FROM p a, p b WHERE b.row_id % 5 <> 0 AND a.row_id <> b.row_id),
 near AS MATERIALIZED (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= {K}),
 kth AS (SELECT a AS b, max(d) AS kth FROM near WHERE a % 5 <> 0 GROUP BY a),
 lrd AS MATERIALIZED (SELECT a, 1 / (avg(greatest(d, kth)) + 1e-10) AS lrd, avg(d) AS knn FROM near JOIN kth USING (b) GROUP BY a)
SELECT n.a AS row_id, round(-avg(t.lrd) / max(o.lrd), 6) AS lof, round(max(o.knn), 6) AS knn FROM near n JOIN lrd t ON t.a = n.b JOIN lrd o ON o.a = n.a WHERE n.a % 5 = 0 GROUP BY n.a"""


@query(sql(_LOF, "routes"))
def r07_outlier_factor(spark, d):
    """Local outlier factor and mean neighbour distance of held-out routes among training ones."""
    p = latent.paths(fx.routes(spark, d))
    return neighbours.outlier_factor(p.where(TRAIN), p.where(TEST), K).select("row_id", r6("lof"), r6("knn"))


def sizes_of(routes) -> list[int]:
    """How many codes each layer has."""
    return [r.k for r in routes.groupBy("layer").agg((F.max("state") + 1).alias("k")).orderBy("layer").collect()]  # a row a layer


def losses(scored):
    """Mean loss of a route and the mean of its four greatest."""
    worst = F.slice(F.sort_array("losses", asc=False), 1, 4)
    return scored.select("row_id", F.round(A.total(F.col("losses")) / F.size("losses"), 4).alias("mean"), F.round(A.total(worst) / F.size(worst), 4).alias("top4"))


@query()
def r05_markov_mixture(spark, d):
    """Losses of held-out routes under a mixture of chains fitted to the training ones."""
    routes = fx.routes(spark, d)
    rows = latent.paths(routes)
    p, _ = latent.mixture(rows.where(TRAIN), sizes_of(routes), iterations=30)
    return losses(latent.mixture_losses(rows.where(TEST), p))


_U = uniform_sql("mix", "row_id")
_STEP = f"""u AS MATERIALIZED (SELECT row_id, layer, lag(state) OVER (PARTITION BY row_id ORDER BY layer) AS a, state AS b, {_U} AS u FROM routes),
 k AS (SELECT layer, max(state) + 1 AS k FROM routes GROUP BY layer),
 cls AS (SELECT unnest([0, 1]) AS j), tr AS (SELECT u.*, j, CASE WHEN j = 0 THEN u ELSE 1 - u END AS r FROM u, cls WHERE row_id % 5 <> 0),
 c AS (SELECT layer, j, coalesce(a, -1) AS a, b, sum(r) AS c FROM tr GROUP BY ALL), n AS (SELECT layer, j, a, sum(c) AS n FROM c GROUP BY ALL),
 w AS (SELECT j, ln((sum(r) + 0.1) / (sum(sum(r)) OVER () + 0.2)) AS w FROM tr WHERE layer = 0 GROUP BY j),
 s AS (SELECT row_id, u.layer, cls.j, ln((coalesce(c.c, 0) + 0.1) / (coalesce(n.n, 0) + 0.1 * k)) AS lp FROM u CROSS JOIN cls JOIN k ON k.layer = u.layer LEFT JOIN c ON c.layer = u.layer AND c.j = cls.j AND c.a = coalesce(u.a, -1) AND c.b = u.b LEFT JOIN n ON n.layer = u.layer AND n.j = cls.j AND n.a = coalesce(u.a, -1) WHERE row_id % 5 = 0),
 t AS (SELECT row_id, j, sum(lp) + max(w) AS lj FROM s JOIN w USING (j) GROUP BY ALL)
SELECT row_id, round(ln(sum(exp(lj))), 6) AS logp, round(sum(exp(lj)) FILTER (j = 0) / sum(exp(lj)), 6) AS first FROM t GROUP BY row_id"""


@query(sql(_STEP, "routes"))
def r05_mixture_step(spark, d):
    """One step of the same fit from hash-drawn shares: log chance and share of the first class."""
    routes = fx.routes(spark, d)
    rows, u = latent.paths(routes), uniform("mix", F.col("row_id"))
    drawn = rows.where(TRAIN).withColumns({"n": F.lit(1.0), "share": F.array(u, 1 - u)})
    p = latent.class_update(latent.class_counts(drawn, 2), sizes_of(routes), 2, 0.1)
    e = latent.class_joint(rows.where(TEST), p).withColumn("logp", A.log_sum_exp(F.col("joint")))
    return e.select("row_id", r6("logp"), F.round(F.exp(F.col("joint")[0] - F.col("logp")), 6).alias("first"))


@query()
def r06_layer_hmm(spark, d):
    """Losses of held-out routes under a hidden chain fitted to the training ones."""
    routes = fx.routes(spark, d)
    rows = latent.paths(routes)
    p, _ = latent.hidden(rows.where(TRAIN), sizes_of(routes), iterations=30)
    return losses(latent.hidden_losses(rows.where(TEST), p))


def _exchanged_sql() -> str:
    """A pointer a row: at each inner layer it moves to the row of the same rank in a hash order
    of those with its state and fold."""
    views = ["p0 AS (SELECT DISTINCT row_id, row_id % 3 AS fold, row_id AS source FROM routes)"]
    picks = ["SELECT p0.row_id, layer, state FROM p0 JOIN routes ON routes.row_id = source WHERE layer = 0", "SELECT p0.row_id, layer, state FROM p0 JOIN routes ON routes.row_id = source WHERE layer = 1"]
    for l in range(1, 7):
        salt = uniform_sql(f"suffix|{l}", "state || '|' || fold || '|' || p.row_id")
        views.append(f"h{l} AS MATERIALIZED (SELECT p.row_id, fold, source, state, row_number() OVER (PARTITION BY state, fold ORDER BY p.row_id) AS a, row_number() OVER (PARTITION BY state, fold ORDER BY {salt}) AS b FROM p{l - 1} p JOIN routes ON routes.row_id = source AND layer = {l})")
        views.append(f"p{l} AS MATERIALIZED (SELECT x.row_id, x.fold, y.source FROM h{l} x JOIN h{l} y ON x.state = y.state AND x.fold = y.fold AND x.a = y.b)")
        picks.append(f"SELECT p{l}.row_id, layer, state FROM p{l} JOIN routes ON routes.row_id = source WHERE layer = {l + 1}")
    return ", ".join(views) + " " + " UNION ALL ".join(picks)


@query(sql(_exchanged_sql(), "routes"))
def n04_suffix_exchange(spark, d):
    """Routes whose suffixes changed hands at shared inner states within three folds."""
    r = fx.routes(spark, d).select("row_id", "layer", "state")
    folds = r.select("row_id").distinct().withColumn("fold", F.col("row_id") % 3)
    return nulls.suffixes_exchanged(r, folds, "suffix")
