"""Conditional routing between classes and its permutation nulls. Steps are rows with a group
(origin state, stratum and what else a test keeps apart), a destination and a label 0 or 1."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.functions.stats import drawn_place, log_factorial, place
from layerroutes.sources.scratch import cut


def js_bits(p: Column, q: Column) -> Column:
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return (part(p, q) + part(q, p)) / 2


def _cells(steps: DataFrame, by: list[str], group: list[str]) -> DataFrame:
    """Rows of each destination of a group (m), and those of either class (a of label 1, b)."""
    return steps.groupBy(*by, *group, "dest").agg(F.count("*").alias("m"), F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))


def conditional_js(steps: DataFrame, by: list[str], group: list[str], least: int = 2) -> DataFrame:
    """Per ``by``: js, the mean Jensen-Shannon divergence in bits of the classes' destinations
    over groups with ``least`` rows of each class, weighted by rows; support, their rows."""
    return _js_of(_cells(steps, by, group), by, group, least)


def _js_of(c: DataFrame, by: list[str], group: list[str], least: int) -> DataFrame:
    keys = [*by, *group]
    w = Window.partitionBy(*keys)  # over the destinations of a group
    t = c.withColumns({"na": F.sum("a").over(w), "nb": F.sum("b").over(w)}).where((F.col("na") >= least) & (F.col("nb") >= least))
    g = t.groupBy(*keys).agg(F.max(F.col("na") + F.col("nb")).alias("w"), F.sum(js_bits(F.col("a") / F.col("na"), F.col("b") / F.col("nb"))).alias("js"))
    return g.groupBy(*by).agg((F.sum(F.col("w") * F.col("js")) / F.sum("w")).alias("js"), F.sum("w").cast("long").alias("support"))


def permuted_labels(rows: DataFrame, group: list[str], ident: str, replicates: int, salt: str) -> DataFrame:
    """``rows`` once per replicate (column rep), labels dealt anew within each group: the rows
    first in a hash order take the ones. Group sizes and class counts stay. A group of any size
    is ranked in parts of the hash's range."""
    ones = rows.groupBy(*group).agg(F.sum("label").alias("_ones"))
    each = rows.join(ones, group).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ranked = drawn_place(each, [*group, "rep"], salt, ["rep", ident], "_rank")
    return ranked.withColumn("label", (F.col("_rank") <= F.col("_ones")).cast("int")).drop("_ones", "_rank")


def shuffled(rows: DataFrame, group: list[str], ident: str, value: str, salt: str, replicates: int | None = None) -> DataFrame:
    """``rows`` with ``value`` dealt anew within each group, by two orders joined on their rank;
    with ``replicates``, once for each of them (column rep). The order by id is that of all. The
    join is merged: its sides are rows, which Spark's estimates take for few after an explode."""
    given, keys = rows.select(*group, ident, value), group
    if replicates is not None:
        given, keys = given.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))), [*group, "rep"]
    given = drawn_place(given, keys, salt, [*keys, ident], "_rank").drop(ident)
    return place(rows.drop(value), group, F.col(ident), "_rank").join(given.hint("merge"), [*group, "_rank"]).drop("_rank")


def suffixes_exchanged(routes: DataFrame, folds: DataFrame, salt: str) -> DataFrame:
    """``routes(row_id, layer, state)`` with whole suffixes dealt anew among the rows that share
    a state and a fold (``folds``: row_id, fold) at an inner layer, layer after layer. Every
    layer's edge counts stay, and so does each row's fold; longer associations go.

    A row only carries the id of the row whose states it goes on with: at a layer rows are
    grouped by the state that this row has there, ranked by id and by hash, and take over the
    pointer of the row of the same rank. States are looked up once a layer."""
    layers = [r.layer for r in routes.select("layer").distinct().orderBy("layer").collect()]  # a row a layer
    cut_ = cut(routes.select(F.col("row_id").alias("source"), "layer", "state"))
    at = lambda l: cut_.where(F.col("layer") == l).select("source", "state")
    now = cut(folds.select("row_id", "fold").withColumn("source", F.col("row_id")))
    out = None
    for i, l in enumerate(layers):
        here = now.join(at(l), "source")
        made = here.select("row_id", F.lit(l).alias("layer"), "state")
        out = made if out is None else out.unionByName(made)
        if 0 < i < len(layers) - 1:
            now = cut(shuffled(here, ["state", "fold"], "row_id", "source", f"{salt}|{l}").select("row_id", "fold", "source"))
    return out


def exact_mean(steps: DataFrame, by: list[str], group: list[str], least: int = 2) -> DataFrame:
    """Per ``by``: the exact mean of ``conditional_js`` over all permutations of labels within
    groups: a hypergeometric sum for each destination. Equal cells are counted once. A sum runs
    over counts within twelve standard deviations (and twelve) of its centre: beyond them the
    chance is below 1e-30."""
    return _exact_of(_cells(steps, by, group), by, group, least)


def _exact_of(c: DataFrame, by: list[str], group: list[str], least: int) -> DataFrame:
    keys = [*by, *group]
    w = Window.partitionBy(*keys)
    t = c.withColumns({"n": F.sum("m").over(w), "n1": F.sum("a").over(w)}).where((F.col("n1") >= least) & (F.col("n") - F.col("n1") >= least))
    n, n1, m, x = (F.col(k) for k in ("n", "n1", "m", "x"))
    part, real = n1 / n, n.cast("double")
    far = 12 * F.sqrt(m * part * (1 - part) * (real - m) / (real - 1)) + 12
    low = F.greatest(F.lit(0), m - (n - n1), F.floor(m * part - far)).cast("long")
    high = F.least(m, n1, F.ceil(m * part + far)).cast("long")
    cells = t.select("n", "n1", "m").distinct().withColumn("x", F.explode(F.sequence(low, high)))
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    mass = F.exp(choose(m, x) + choose(n - m, n1 - x) - choose(n, n1))
    mean = cells.groupBy("n", "n1", "m").agg(F.sum(mass * js_bits(x / n1, (m - x) / (n - n1))).alias("e"))
    support = t.groupBy(*by).agg(F.sum("m").alias("support"))
    total = t.join(mean, ["n", "n1", "m"]).groupBy(*by).agg(F.sum(n * F.col("e")).alias("s"))
    return total.join(support, by).select(*by, (F.col("s") / F.col("support")).alias("mean"))


def occupancy_null(routes: DataFrame, group: list[str], replicates: int, salt: str, least: int = 2) -> DataFrame:
    """One row: the mean over layers of the conditional divergence of ``routes(row_id, layer,
    state, label, level)``, its mean over ``replicates`` draws that deal each layer's states anew
    within ``group``, their difference, the 2.5 and 97.5 percentiles and the p-value of the draws;
    and the same (``corrected_``) less, in each map, the exact mean over permuted labels, which
    sparse cells alone would give. All draws run in the same jobs."""
    routes = cut(routes.select("row_id", *group, *(c for c in ("layer", "label", "level", "state") if c not in group)))
    dealt = shuffled(routes.select("row_id", *group, "state"), group, "row_id", "state", salt, replicates)
    every = dealt.select("row_id", "layer", "label", "level", "rep", "state").unionByName(routes.select("row_id", "layer", "label", "level", F.lit(-1).alias("rep"), "state"))
    w = Window.partitionBy("row_id", "rep").orderBy("layer")  # the layers of a row
    steps = every.withColumns({"dest": F.lead("state").over(w), "after": F.lead("layer").over(w)}).where(F.col("after") == F.col("layer") + 1).withColumnRenamed("state", "i")
    by, own = ["layer", "rep"], ["i", "level"]
    cells = cut(_cells(steps, by, own))
    js = _js_of(cells, by, own, least).join(_exact_of(cells, by, own, least), by, "left").withColumn("corrected", F.col("js") - F.col("mean"))
    per = js.groupBy("rep").agg(F.avg("js").alias("js"), F.avg("corrected").alias("corrected"))
    seen = per.where("rep = -1").select(F.col("js").alias("js0"), F.col("corrected").alias("corrected0"))
    out = []
    for c, name in (("js", ""), ("corrected", "corrected_")):
        v, o = F.col(c), F.col(f"{c}0")
        q = lambda p, v=v: F.percentile(v, F.lit(p))  # noqa: E731 - a row a draw
        out += [F.max(o).alias(f"{name}observed"), F.avg(v).alias(f"{name}null_mean"), (F.max(o) - F.avg(v)).alias(f"{name}excess"), q(0.025).alias(f"{name}low"), q(0.975).alias(f"{name}high"), ((1 + F.count(F.when(v >= o - 1e-12, 1))) / (replicates + 1)).alias(f"{name}p")]
    return per.where("rep >= 0").join(F.broadcast(seen)).agg(*out)  # one row
