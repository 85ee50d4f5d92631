"""Clustering steps and fits: one aggregate job an iteration, parameters of K rows a layer."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerroutes.functions.arrays import let, log_sum_exp, total
from layerroutes.functions.hashing import uniform
from layerroutes.operators.distances import nearest


def lloyd_step(states: DataFrame, centers: DataFrame) -> DataFrame:
    """One Lloyd step: (layer, state, n, mu, inertia)."""
    a = nearest(states, centers).select("layer", "state", "dist", F.posexplode("x").alias("i", "v"))
    g = a.groupBy("layer", "state", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.sum("dist").alias("inertia"))
    return g.groupBy("layer", "state").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mu"), F.max("inertia").alias("inertia"))


def kmeans(states: DataFrame, centers: DataFrame, iterations: int = 10, tolerance: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """Lloyd's algorithm from given centres for all layers at once. The driver sees K rows a
    layer in each iteration and the inertia. A centre without rows starts anew from a row far
    from its own, so K centres come out."""
    spark, history, schema = states.sparkSession, [], "layer int, state int, mu array<double>"
    wanted = {(r.layer, r.state) for r in centers.select("layer", "state").collect()}  # K a layer
    for _ in range(iterations):
        rows = lloyd_step(states, centers).collect()  # K rows a layer
        made = {(r.layer, r.state): r.mu for r in rows}
        if empty := wanted - made.keys():
            far = nearest(states, centers).groupBy("layer").agg(*(F.max_by("x", F.col("dist") * uniform(f"empty|{s}", F.col("row_id"))).alias(f"s{s}") for s in sorted({s for _, s in empty}))).collect()  # a row a layer
            far = {r.layer: r for r in far}
            made |= {(layer, s): far[layer][f"s{s}"] for layer, s in empty if layer in far}
        centers = spark.createDataFrame([(*k, mu) for k, mu in sorted(made.items())], schema)
        history.append(sum(r.inertia for r in rows))
        if len(history) > 1 and history[-2] - history[-1] <= tolerance * max(history[-2], 1e-300):
            break
    return centers, history


def _posterior(states: DataFrame, model: DataFrame) -> DataFrame:
    """``states`` with the layer's components (_m, by state) and a struct _p of the log density and
    the responsibilities in that order. An expression on each row: no shuffle of states."""
    per_layer = model.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("state", "weight", "mu", "var"))).alias("_m"))  # K a layer
    terms = lambda c: total(F.zip_with(F.zip_with("x", c["mu"], lambda a, m: (a - m) * (a - m)), c["var"], lambda e, v: e / v + F.log(F.lit(6.283185307179586) * v)))
    joint = F.transform("_m", lambda c: F.log(c["weight"]) - 0.5 * terms(c))
    p = let(joint, lambda j: let(log_sum_exp(j), lambda l: F.struct(l.alias("logp"), F.transform(j, lambda a: F.exp(a - l)).alias("resp"))))
    return states.join(F.broadcast(per_layer), "layer").withColumn("_p", p)


def em_step(states: DataFrame, model: DataFrame, floor: float = 1e-6, covariance: str = "diag") -> DataFrame:
    """One E and M step of a mixture: (layer, state, nk, weight, mu, var). The variances are
    each component's own (diag), one vector for a layer (tied) or one number a component
    (spherical)."""
    each = _posterior(states, model).select("layer", "x", F.explode(F.arrays_zip(F.col("_m.state").alias("state"), F.col("_p.resp").alias("resp"))).alias("c"))
    r = each.select("layer", "c.state", "c.resp", F.posexplode("x").alias("i", "v"))
    g = r.groupBy("layer", "state", "i").agg(F.sum("resp").alias("nk"), F.sum(F.col("resp") * F.col("v")).alias("s"), F.sum(F.col("resp") * F.col("v") * F.col("v")).alias("q"))
    m = g.withColumn("m", F.col("s") / F.col("nk")).withColumn("var", F.greatest(F.col("q") / F.col("nk") - F.col("m") * F.col("m"), F.lit(0.0)) + floor)
    n = states.groupBy("layer").agg(F.count("*").alias("n"))
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c])
    if covariance == "tied":
        tied = m.groupBy("layer", "i").agg((F.sum(F.col("nk") * F.col("var")) / F.sum("nk")).alias("var"))
        m = m.drop("var").join(tied, ["layer", "i"])
    elif covariance == "spherical":
        m = m.drop("var").join(m.groupBy("layer", "state").agg(F.avg("var").alias("var")), ["layer", "state"])
    elif covariance != "diag":
        raise ValueError(f"no such covariance: {covariance}")
    return m.groupBy("layer", "state").agg(F.max("nk").alias("nk"), pick("m").alias("mu"), pick("var").alias("var")).join(n, "layer").withColumn("weight", F.col("nk") / F.col("n")).drop("n")


def plus_plus(states: DataFrame, sizes: dict[int, int], seed: int = 0) -> DataFrame:
    """First centres for each layer, as many as ``sizes`` says: rows drawn one a round with
    chances in proportion to the squared distance from the nearest drawn one. A draw is the
    least of -ln(u) / distance over the rows, u a hash of the id: one aggregate a round."""
    spark, got = states.sparkSession, []
    schema = "layer int, state int, mu array<double>"
    for k in range(max(sizes.values())):
        live = states.where(F.col("layer").isin([a for a, n in sizes.items() if n > k]))
        u = -F.log(1 - uniform(f"{seed}|{k}", F.col("layer"), F.col("row_id")))
        if got:
            live = nearest(live, spark.createDataFrame(got, schema)).where("dist > 0")
            u = u / F.col("dist")
        draw = live.groupBy("layer").agg(F.min_by("x", F.struct(u.alias("u"), F.col("row_id"))).alias("mu"))
        got += [(r.layer, k, r.mu) for r in draw.collect()]  # a row a layer
    return spark.createDataFrame(got, schema)


def hard_model(states: DataFrame, centers: DataFrame, floor: float = 1e-6) -> DataFrame:
    """The diagonal mixture of a hard assignment: (layer, state, weight, mu, var)."""
    a = nearest(states, centers).select("layer", "state", F.posexplode("x").alias("i", "v"))
    g = a.groupBy("layer", "state", "i").agg(F.avg("v").alias("m"), (F.var_pop("v") + floor).alias("s2"), F.count("*").alias("n"))
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c])
    m = g.groupBy("layer", "state").agg(F.max("n").alias("n"), pick("m").alias("mu"), pick("s2").alias("var"))
    return m.join(states.groupBy("layer").agg(F.count("*").alias("_n")), "layer").withColumn("weight", F.col("n") / F.col("_n")).drop("n", "_n")


def em(states: DataFrame, model: DataFrame, iterations: int = 10) -> DataFrame:
    """EM of a diagonal mixture from a model; K rows a layer come to the driver each time."""
    for _ in range(iterations):
        rows = em_step(states, model).select("layer", "state", "weight", "mu", "var").collect()
        model = states.sparkSession.createDataFrame([tuple(r) for r in rows], "layer int, state int, weight double, mu array<double>, var array<double>")
    return model


def information(states: DataFrame, model: DataFrame) -> DataFrame:
    """(layer, k, bic, icl) of a diagonal mixture."""
    h = total(F.transform("_p.resp", lambda r: F.when(r > 0, -r * F.log(r)).otherwise(0.0)))
    g = _posterior(states, model).select("layer", F.col("_p.logp").alias("l"), h.alias("h")).groupBy("layer").agg(F.sum("l").alias("ll"), F.sum("h").alias("h"), F.count("*").alias("n"))
    k = model.groupBy("layer").agg(F.count("*").alias("k"), F.max(F.size("mu")).alias("d"))
    bic = -2 * F.col("ll") + (2 * F.col("k") * F.col("d") + F.col("k") - 1) * F.log("n")
    return g.join(k, "layer").select("layer", "k", bic.alias("bic"), (bic + 2 * F.col("h")).alias("icl"))


def rand_by(df: DataFrame, by: list[str], a: str, b: str, n: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labellings per ``by``, from their contingency table; column ``n``,
    if named, says for how many rows a row stands."""
    two = lambda c: c * (c - 1) / 2
    cells = df.groupBy(*by, a, b).agg((F.sum(n) if n else F.count("*")).cast("double").alias("c"))
    side = lambda k: cells.groupBy(*by, k).agg(F.sum("c").alias("c")).groupBy(*by).agg(F.sum(two(F.col("c"))).alias(f"s_{k}"))
    g = cells.groupBy(*by).agg(F.sum(two(F.col("c"))).alias("s"), F.sum("c").alias("n")).join(side(a), by).join(side(b), by)
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / two(F.col("n"))
    top = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2 - expected
    return g.select(*by, F.when(top == 0, 1.0).otherwise((F.col("s") - expected) / F.when(top != 0, top)).alias("ari"))


def stability(states: DataFrame, sizes: dict[int, int], repeats: int = 2, seed: int = 0, iterations: int = 5) -> DataFrame:
    """(layer, stability): mean adjusted Rand index over pairs of refits with other seeds."""
    fits = [nearest(states, kmeans(states, plus_plus(states, sizes, seed + 10007 * r), iterations)[0]).select("row_id", "layer", F.col("state").alias(f"l{r}")) for r in range(repeats)]
    out = None
    for i in range(repeats):
        for j in range(i + 1, repeats):
            one = rand_by(fits[i].join(fits[j], ["row_id", "layer"]), ["layer"], f"l{i}", f"l{j}")
            out = one if out is None else out.union(one)
    return out.groupBy("layer").agg(F.avg("ari").alias("stability"))
