"""Queries of fitted models: bases, factor models, readouts, refits, surrogates, latent routes.
SQL cannot express their fits; tests hold them against direct computations."""

from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.functions.hashing import fold, normal, uniform
from layerroutes.functions.stats import auroc
from layerroutes.operators import align, bayes, cluster, distances, fits, latent
from layerroutes.operators.transforms import Chain
from layerroutes.plans import fixtures as fx
from layerroutes.plans.fixtures import sql
from layerroutes.plans.registry import query
from layerroutes.sources.scratch import cut

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
TRAIN, TEST = "row_id % 5 <> 0", "row_id % 5 = 0"
STANDARD = {"step": "standardise"}


def labelled(spark, d, layer=7):
    """A layer's vectors, standardised by the training rows, with labels."""
    s = fx.states(spark, d).where(F.col("layer") == layer)
    x = Chain([STANDARD]).fit(s.where(TRAIN)).transform(s)
    return x.join(fx.emb(spark, d).select("row_id", "label", "category", "level", "n_tokens"), "row_id")


def stated(spark, d):
    """Vectors with their states."""
    return fx.states(spark, d).join(fx.routes(spark, d).select("row_id", "layer", "state"), ["row_id", "layer"])


@query()
def t02_pca(spark, d):
    """Four whitened components of the training rows, and how far the way back misses."""
    s = fx.states(spark, d)
    b = fits.packed(fits.bases(s.where(TRAIN), ["layer"], 4), ["layer"])
    z = s.join(b, "layer").withColumn("z", fits.scores(F.col("x"), F.col("mean"), F.col("basis"), True))
    back = fits.restored(F.col("z"), F.col("mean"), F.col("basis"), True)
    return z.select("row_id", "layer", A.rounded(F.col("z")).alias("z"), r6(F.sqrt(A.sq_dist(F.col("x"), back)), "miss"))


@query()
def t04_chain(spark, d):
    s = fx.states(spark, d)
    c = Chain([STANDARD, {"step": "pca", "rank": 8, "whiten": True}], must_invert=True).fit(s.where(TRAIN))
    there = c.transform(s)
    back = c.inverse(there).withColumnRenamed("x", "y")
    return there.join(back, ["row_id", "layer"]).join(s.withColumnRenamed("x", "x0"), ["row_id", "layer"]).select("row_id", "layer", A.rounded(F.col("x"), 4).alias("x"), F.round(F.sqrt(A.sq_dist(F.col("y"), F.col("x0"))), 4).alias("miss"))


@query()
def g03_spectrum(spark, d):
    return fits.spectrum(fx.states(spark, d), ["layer"]).select("layer", "n", r6("trace"), A.rounded(F.col("eigenvalues")).alias("eigenvalues"), A.rounded(F.col("shares")).alias("shares"), "d90", "d95", r6("entropy_rank"))


@query()
def i03_effective_rank(spark, d):
    """Ranks for 90 % of the variance over hash subsamples of three sizes, two repeats each."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(r).alias("rep")) for f in (0.25, 0.5, 1.0) for r in (0, 1))))
    s = fx.states(spark, d).withColumn("c", cells).select("row_id", "layer", "x", "c.*")
    s = s.where(uniform("rank", F.col("rep"), F.col("row_id")) < F.col("fraction"))
    return fits.spectrum(s, ["layer", "fraction", "rep"]).select("layer", "fraction", "rep", "n", "d90", "d95")


def local_bases(spark, d, rank):
    return fits.packed(fits.bases(stated(spark, d).where(TRAIN), ["layer", "state"], rank), ["layer", "state"])


@query()
def g09_subspace_overlap(spark, d):
    """Mean squared cosine of the principal angles between the states' leading planes."""
    b = local_bases(spark, d, 2)
    o = b.select("layer", F.col("state").alias("other"), F.col("basis").alias("theirs"))
    sq = lambda u: A.total(F.transform("theirs", lambda v: A.dot(u["vector"], v["vector"]) * A.dot(u["vector"], v["vector"])))
    q = F.least(F.size("basis"), F.size("theirs"))
    return b.join(o, "layer").where("state < other").select("layer", "state", "other", r6(A.total(F.transform("basis", sq)) / q, "overlap"))  # K x K a layer


def _errors(rows, by, methods):
    """Squared miss over squared distance from the training mean, per method."""
    base = F.sum(A.sq_dist(F.col("x"), F.col("gm")))
    return rows.groupBy(*by).agg(*(r6(F.sum(A.sq_dist(F.col("x"), m)) / base, n) for n, m in methods.items()))


@query()
def x01_reconstruct(spark, d):
    """Held-out rows rebuilt by seven methods."""
    g = fits.packed(fits.bases(fx.states(spark, d).where(TRAIN), ["layer"], 4), ["layer"]).select("layer", F.col("mean").alias("gm"), F.col("basis").alias("gb"))
    n = distances.nearest(fx.states(spark, d).where(TEST), fx.centers(spark, d)).select("row_id", "layer", "state", "x", "mu")
    t = n.join(g, "layer").join(local_bases(spark, d, 2).withColumnRenamed("mean", "em"), ["layer", "state"])
    around = lambda c, b: fits.restored(fits.scores(F.col("x"), F.col(c), F.col(b)), F.col(c), F.col(b))
    return _errors(t, ["layer"], {"identity": F.col("x"), "zero": F.transform("x", lambda v: F.lit(0.0)), "mean": F.col("gm"), "centroid": F.col("mu"), "global_pca": around("gm", "gb"), "local_pca": around("mu", "basis"), "empirical_pca": around("em", "basis")})


@query()
def x04_local_projection(spark, d):
    """Half-way moves to a region's own plane, to another region's, to the layer's, and with the
    norm kept; regions are deranged by a turn of their order."""
    b = local_bases(spark, d, 2).select("layer", "state", "basis")
    k = b.groupBy("layer").agg(F.sort_array(F.collect_list("state")).alias("ks"))
    turn = b.join(k, "layer").select("layer", F.element_at("ks", (F.array_position("ks", F.col("state")) % F.size("ks") + 1).cast("int")).alias("state"), F.col("basis").alias("wrong"))
    shared = fits.packed(fits.bases(fx.states(spark, d).where(TRAIN), ["layer"], 2), ["layer"]).select("layer", F.col("basis").alias("shared"))
    n = distances.nearest(fx.states(spark, d), fx.centers(spark, d)).select("row_id", "layer", "state", "x", "mu")
    t = n.join(b, ["layer", "state"]).join(turn, ["layer", "state"]).join(shared, "layer")
    x = F.col("x")
    z = {c: fits.restored(fits.scores(x, F.col("mu"), F.col(c)), F.col("mu"), F.col(c)) for c in ("basis", "wrong", "shared")}
    t = t.select("row_id", "layer", "state", "x", *(v.alias(f"z_{c}") for c, v in z.items()))
    own = F.col("z_basis")
    t = t.withColumn("z_norm", F.when(A.norm(own) > 1e-12, F.transform(own, lambda v: v * A.norm(x) / A.norm(own))).otherwise(x))
    move = lambda c: r6(0.5 * F.sqrt(A.sq_dist(F.col(c), x)) / A.norm(x), c[2:])
    return t.select("row_id", "layer", "state", *map(move, ("z_basis", "z_wrong", "z_shared", "z_norm")))


@query()
def x05_radial_control(spark, d):
    """A random change with the size, the radial part and the final norm of a given one."""
    n = distances.nearest(fx.states(spark, d), fx.centers(spark, d)).where("dist > 0").select("row_id", "layer", "x", A.minus(F.col("mu"), F.col("x")).alias("delta"))
    x, dl, e = F.col("x"), F.col("delta"), A.dot(F.col("x"), F.col("x"))
    draw = F.array(*(normal("radial", F.col("row_id"), F.col("layer"), F.lit(i)) for i in range(fx.WIDTH)))
    along = lambda v: F.transform(x, lambda a: a * A.dot(x, v) / e)
    n = n.withColumn("draw", draw)
    n = n.withColumns({"tangent": A.minus(F.col("draw"), along(F.col("draw"))), "radial": along(dl)})
    size = F.sqrt(A.sq_dist(dl, F.col("radial"))) / A.norm(F.col("tangent"))
    n = n.withColumn("size", size).withColumn("change", F.zip_with("radial", F.transform("tangent", lambda v: v * F.col("size")), lambda a, b: a + b))
    total = lambda c: F.zip_with(x, F.col(c), lambda a, b: a + b)
    return n.select("row_id", "layer", A.rounded(F.col("change")).alias("change"), r6(A.norm(F.col("change")) - A.norm(dl), "size_gap"), r6(A.dot(x, F.col("change")) - A.dot(x, dl), "radial_gap"), r6(A.norm(total("change")) - A.norm(total("delta")), "norm_gap"))


def factor_model(spark, d, q=2):
    """Factor models of the states that have more training rows than coordinates."""
    return fits.factors(stated(spark, d).where(TRAIN), ["layer", "state"], q).where(F.col("n") > fx.WIDTH)


@query()
def c07_factor_analysis(spark, d):
    m = factor_model(spark, d)
    return m.select("layer", "state", "n", A.rounded(F.col("mean")).alias("mean"), F.round(A.total(F.transform("loadings", lambda v: v * v)), 4).alias("factor_trace"), F.round(A.total(F.col("noise")), 4).alias("noise_trace"))


@query()
def g07_factor_dimensions(spark, d):
    return fits.dimensions(factor_model(spark, d), ["layer", "state"], 2).select("layer", "state", *(F.round(c, 4).alias(c) for c in ("factor_pr", "noise_pr", "model_pr", "factor_share", "entropy_rank")), "d90")


@query()
def d05_factor_joint(spark, d):
    return fits.factor_rows(fx.states(spark, d), factor_model(spark, d), 2).select("row_id", "layer", "state", F.round("logp", 4).alias("logp"))


@query()
def d06_factor_distances(spark, d):
    f = fits.factor_rows(fx.states(spark, d), factor_model(spark, d), 2)
    return f.select("row_id", "layer", "state", *(F.round(c, 4).alias(c) for c in ("latent", "residual", "parallel", "across")), F.round(F.hypot("latent", "residual"), 4).alias("mahalanobis"), F.round(F.hypot("parallel", "across"), 4).alias("euclid"))


@query()
def x06_factor_reconstruction(spark, d):
    f = fits.factor_rows(fx.states(spark, d).where(TEST), factor_model(spark, d), 2)
    return f.groupBy("layer").agg(F.round(F.avg("hard_error"), 4).alias("hard_error"), F.round(F.avg("soft_error"), 4).alias("soft_error"), F.count("*").alias("n"))


@query()
def c06_factor_mixture(spark, d):
    m, _ = fits.factor_mixture(fx.states(spark, d).where(TRAIN), factor_model(spark, d), 2, iterations=3)
    return m.select("layer", "state", F.round("n", 4).alias("n"), A.rounded(F.col("mean"), 4).alias("mean"), F.round(A.total(F.col("noise")), 4).alias("noise_trace"))


def _kmap(spark, d):
    """A stored number of states for each layer: those of the frozen centres."""
    return {r.layer: r.k for r in fx.centers(spark, d).groupBy("layer").agg(F.count("*").alias("k")).collect()}


@query()
def c05_first_centres(spark, d):
    return cluster.plus_plus(fx.states(spark, d), _kmap(spark, d)).select("layer", "state", A.rounded(F.col("mu")).alias("mu"))


@query()
def c09_fixed_k(spark, d):
    """Refit with the stored numbers of states."""
    s = fx.states(spark, d)
    c, _ = cluster.kmeans(s, cluster.plus_plus(s, _kmap(spark, d), seed=7), iterations=4)
    return cluster.lloyd_step(s, c).select("layer", "state", "n", A.rounded(F.col("mu")).alias("mu"))


@query()
def m03_stability(spark, d):
    return cluster.stability(fx.states(spark, d), {k: 3 for k in range(fx.LAYERS)}, repeats=2, iterations=3).select("layer", r6("stability"))


@query()
def m04_scan(spark, d):
    """A row per layer and k: criteria of a mixture fitted from k-means, and stability."""
    s, out = fx.states(spark, d), []
    for k in (2, 3):
        sizes = {layer: k for layer in range(fx.LAYERS)}
        c, _ = cluster.kmeans(s, cluster.plus_plus(s, sizes), iterations=3)
        m = cluster.em(s, cluster.hard_model(s, c), iterations=2)
        out.append(cluster.information(s, m).join(cluster.stability(s, sizes, iterations=3), "layer"))
    return reduce(lambda a, b: a.union(b), out).select("layer", "k", F.round("bic", 2).alias("bic"), F.round("icl", 2).alias("icl"), r6("stability"))


@query()
def c10_surrogate(spark, d):
    """Gaussian rows with the training rows' mean and covariance, a draw by each row's id."""
    b = fits.packed(fits.bases(fx.states(spark, d).where(TRAIN), ["layer"], fx.WIDTH), ["layer"])
    z = F.array(*(normal("surrogate", F.col("row_id"), F.col("layer"), F.lit(i)) for i in range(fx.WIDTH)))
    s = fx.states(spark, d).select("row_id", "layer").join(b, "layer").withColumn("z", z)
    return s.select("row_id", "layer", A.rounded(fits.restored(F.slice("z", 1, F.size("basis")), F.col("mean"), F.col("basis"), True)).alias("x"))


@query()
def g17_radius_control(spark, d):
    """Squared radii, over their mean, of Gaussian rows with a layer's spectrum."""
    sp = fits.spectrum(fx.states(spark, d), ["layer"]).select("layer", "trace", "eigenvalues")
    z = F.array(*(normal("radius", F.col("row_id"), F.col("layer"), F.lit(i)) for i in range(fx.WIDTH)))
    r = fx.states(spark, d).select("row_id", "layer").join(sp, "layer").select("row_id", "layer", (A.dot(F.col("eigenvalues"), F.transform(z, lambda v: v * v)) / F.col("trace")).alias("r"))
    return r.select("row_id", "layer", r6("r", "radius2"))


def _features(rows):
    """Stored once: a fit reads its rows in each pass, and would join and broadcast them anew."""
    return cut(rows).withColumn("features", array_to_vector("x")).withColumn("y", F.col("label").cast("double"))


def _scored(model, rows, column="rawPrediction"):
    raw = vector_to_array(F.col(column))
    return model.transform(rows).select("row_id", "label", raw[1].alias("score"), F.col("prediction").cast("int").alias("predicted"))


def _fit(estimator, spark, d):
    x = _features(labelled(spark, d))
    return _scored(estimator.fit(x.where(TRAIN)), x.where(TEST)).select("row_id", "label", F.round("score", 4).alias("score"), "predicted")


def _logistic(n, c=1.0):
    """L2 strength 1 / (C n), no penalty on the intercept, vectors standardised before."""
    return LogisticRegression(labelCol="y", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=100)


@query()
def l08_logistic(spark, d):
    n = fx.emb(spark, d).where(TRAIN).count()
    return _fit(_logistic(n), spark, d)


@query()
def l09_linear_svm(spark, d):
    n = fx.emb(spark, d).where(TRAIN).count()
    return _fit(LinearSVC(labelCol="y", regParam=1.0 / max(n, 1), standardization=False, maxIter=50), spark, d)


@query()
def l10_discriminant(spark, d):
    x = labelled(spark, d)
    w = fits.discriminant(x.where(TRAIN), ["layer"])
    return x.where(TEST).join(w, "layer").select("row_id", "label", r6(A.dot(F.col("x"), F.col("w")) + F.col("intercept"), "log_odds"))


@query()
def l12_perceptron(spark, d):
    return _fit(MultilayerPerceptronClassifier(labelCol="y", layers=[fx.WIDTH, 8, 2], maxIter=30, seed=7), spark, d)


@query()
def l13_comparison(spark, d):
    """Methods by fold: AUROC, accuracy and F1, their means and deviations over the folds."""
    rt = fx.rt(spark, d).withColumn("fold", fold("compare", F.col("row_id"), 3))
    x = labelled(spark, d).withColumn("fold", fold("compare", F.col("row_id"), 3))
    parts = []
    for k in range(3):
        nb = bayes.states(rt.where(F.col("fold") != k), rt.where(F.col("fold") == k)).withColumnRenamed("log_odds", "s").join(x.select("row_id", "label"), "row_id")
        w = fits.discriminant(x.where(F.col("fold") != k), ["layer"])
        ld = x.where(F.col("fold") == k).join(w, "layer").select("row_id", (A.dot(F.col("x"), F.col("w")) + F.col("intercept")).alias("s"), "label")
        parts += [f.select("label", "s", F.lit(n).alias("method"), F.lit(k).alias("fold")) for n, f in (("state_bayes", nb), ("discriminant", ld))]
    s = reduce(lambda a, b: a.union(b), parts)
    hit = lambda y, p: F.count(F.when((F.col("label") == y) & ((F.col("s") > 0) == p), 1))
    tp, fp, fn, tn = hit(1, True), hit(0, True), hit(1, False), hit(0, False)
    m = s.groupBy("method", "fold").agg(((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1"))
    t = m.join(auroc(s, "s", "label", ["method", "fold"]).select("method", "fold", "auroc"), ["method", "fold"])
    return t.groupBy("method").agg(*(r6(f(c), f"{c}_{n}") for c in ("auroc", "accuracy", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


@query()
def l14_tuned(spark, d):
    """Strength chosen by inner folds' AUROC on training rows; test labels are only scored."""
    x = _features(labelled(spark, d)).withColumn("inner", fold("inner", F.col("row_id"), 3))
    lr = LogisticRegression(labelCol="y", standardization=False, maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1e-3, 1e-1]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=3, foldCol="inner")
    best = cv.fit(x.where(TRAIN))
    s = _scored(best.bestModel, x.where(TEST))
    return auroc(s, "score", "label").select(F.lit(float(best.bestModel.getRegParam())).alias("strength"), r6("auroc"))


@query()
def l16_residuals(spark, d):
    """Vectors and labels without category, level, length and size, fitted on training rows.
    Categories of fewer than 20 training rows go together."""
    x = labelled(spark, d)
    known = [r.category for r in x.where(TRAIN).groupBy("category").agg(F.count("*").alias("n")).where("n >= 20").orderBy("category").collect()]  # categories
    c = F.when(F.col("category").isin(known), F.col("category")).otherwise("__other__")
    hot = [(c == k).cast("double") for k in known[1:] + ["__other__"]] + [(F.col("level") == k).cast("double") for k in range(2, 6)]
    size = F.log(F.greatest(A.norm(F.col("x")) / (fx.WIDTH**0.5), F.lit(1e-12)))
    design = F.array(*hot, F.log1p("n_tokens"), size)
    width = len(hot) + 2
    rows = x.withColumn("x", F.concat(design, "x", F.array(F.col("label").cast("double"))))
    w = fits.least_squares(rows.where(TRAIN), ["layer"], width)
    packed = w.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("target", "w", "intercept"))).alias("ws"))  # a row a coordinate
    given = F.slice("x", 1, width)
    left = F.zip_with(F.slice("x", width + 1, fx.WIDTH + 1), "ws", lambda v, b: v - A.dot(given, b["w"]) - b["intercept"])
    return rows.join(packed, "layer").select("row_id", "layer", A.rounded(left).alias("residual"))


@query()
def l17_ridge_direction(spark, d):
    """Ridge directions of label and length on the last layer, their cosines with the
    label's, and the share of the variance that each explains on held-out rows."""
    x = labelled(spark, d).withColumn("targets", F.array(*(F.col(c).cast("double") for c in ("label", "n_tokens"))))
    w = fits.ridge(x.where(TRAIN).withColumn("x", F.concat("x", "targets")), ["layer"], fx.WIDTH, 100.0)
    first = w.where("target = 0").select("layer", F.col("w").alias("w0"))
    t = x.where(TEST).join(w, "layer").withColumn("t", F.get("targets", F.col("target"))).withColumn("e", F.col("t") - A.dot(F.col("x"), F.col("w")) - F.col("intercept"))
    r2 = t.groupBy("target").agg(r6(1 - F.sum(F.col("e") * F.col("e")) / F.nullif(F.var_pop("t") * F.count("*"), F.lit(0.0)), "r2"))
    return w.join(first, "layer").select("target", r6(A.cosine(F.col("w"), F.col("w0")), "cosine")).join(r2, "target")


@query()
def l18_platt(spark, d):
    """Calibration of scores by a slope that cannot turn negative."""
    rt = fx.rt(spark, d)
    s = bayes.states(rt.where(TRAIN), rt.where(TEST)).join(fx.emb(spark, d).select("row_id", "label"), "row_id")
    m = s.agg(F.avg("log_odds").alias("m"), F.greatest(F.stddev_pop("log_odds"), F.lit(1e-8)).alias("sd"))  # one row
    x = _features(s.join(m).withColumn("x", F.array((F.col("log_odds") - F.col("m")) / F.col("sd"))))
    from pyspark.ml.linalg import DenseMatrix

    lr = LogisticRegression(labelCol="y", regParam=2e-4, standardization=False, lowerBoundsOnCoefficients=DenseMatrix(1, 1, [0.0]))
    p = vector_to_array(F.col("probability"))
    return lr.fit(x).transform(x).select("row_id", "label", F.round(p[1], 4).alias("p"))


@query()
def a05_threshold_sweep(spark, d):
    """Optimal matches kept from several thresholds on: the share kept and the ids in all."""
    c = fx.means(spark, d)
    m = align.optimal(align.similarities(c), -1.0, allow_negative=True)
    parts = []
    for t in (-1.0, 0.2, 0.5):
        kept = m.where(F.col("sim") >= t)
        ids = align.align_layers(c, kept).agg((F.max("state") + 1).alias("ids"))
        rate = m.agg(r6(F.avg((F.col("sim") >= t).cast("int")), "accepted"))
        parts.append(rate.join(ids).select(F.lit(t).alias("threshold"), "accepted", "ids"))
    return reduce(lambda a, b: a.union(b), parts)


@query()
def a06_growing_pool(spark, d):
    return align.to_pool(fx.means(spark, d), threshold=0.2)


@query()
def a07_anchor(spark, d):
    return align.to_pool(fx.means(spark, d), anchor=0).drop("pool")


@query()
def a11_compare_results(spark, d):
    """Two results over the same rows: frozen centres, and those after a Lloyd step."""
    a, b = fx.means(spark, d), cluster.lloyd_step(fx.states(spark, d), fx.means(spark, d)).select("layer", "state", "mu")
    pairs = a.select("layer", F.col("state").alias("a"), "mu").join(b.select("layer", F.col("state").alias("b"), F.col("mu").alias("y")), "layer").select("layer", "a", "b", A.cosine(F.col("mu"), F.col("y")).alias("sim"))
    m = align.optimal(pairs, -1.0, allow_negative=True).groupBy("layer").agg(r6(F.avg(1 - F.col("sim")), "matched_distance"), F.count("*").alias("matched"))
    rand = pairs.groupBy("layer").agg(r6(F.avg(1 - F.col("sim")), "pair_distance"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    routes = [distances.nearest(fx.states(spark, d), c).select("row_id", "layer", F.col("state").alias(n)) for c, n in ((a, "l0"), (b, "l1"))]
    ari = cluster.rand_by(routes[0].join(routes[1], ["row_id", "layer"]), ["layer"], "l0", "l1").select("layer", r6("ari"))
    return m.join(rand, "layer").join(ari, "layer").select("layer", "matched_distance", "pair_distance", (F.col("ka") - F.col("matched")).alias("unmatched_a"), (F.col("kb") - F.col("matched")).alias("unmatched_b"), "ari")


_VARIANTS = """sd AS (SELECT layer, i, sqrt(var_pop(x[i]) + 1e-8) AS sd FROM states, range(1, 9) t(i) GROUP BY ALL),
 q AS MATERIALIZED (SELECT row_id, s.layer, c.state, sum((x[sd.i] - mu[sd.i]) ** 2) AS p, -sum(x[sd.i] * mu[sd.i]) / sqrt(sum(x[sd.i] ** 2) * sum(mu[sd.i] ** 2)) AS c, sum(((x[sd.i] - mu[sd.i]) / sd) ** 2) AS z FROM states s JOIN centers c ON c.layer = s.layer JOIN sd ON sd.layer = s.layer GROUP BY ALL),
 m AS MATERIALIZED (SELECT row_id, s.layer, c.state, sum((x[i] - mu[i]) ** 2) AS p FROM states s JOIN means c ON c.layer = s.layer, range(1, 9) t(i) GROUP BY ALL),
 l AS MATERIALIZED (SELECT 0 AS v, 'plain' AS name, row_id, layer, state FROM q QUALIFY row_number() OVER (PARTITION BY row_id, layer ORDER BY p, state) = 1
   UNION ALL SELECT 1, 'refit', row_id, layer, state FROM m QUALIFY row_number() OVER (PARTITION BY row_id, layer ORDER BY p, state) = 1
   UNION ALL SELECT k, n, row_id, layer, state FROM q, (VALUES (2, 'cosine'), (3, 'unit')) t(k, n) QUALIFY row_number() OVER (PARTITION BY k, row_id, layer ORDER BY c, state) = 1
   UNION ALL SELECT 4, 'standardised', row_id, layer, state FROM q QUALIFY row_number() OVER (PARTITION BY row_id, layer ORDER BY z, state) = 1),
 c AS (SELECT x.layer, x.name AS a, y.name AS b, x.state AS s, y.state AS t, count(*) AS n FROM l x JOIN l y ON x.row_id = y.row_id AND x.layer = y.layer AND x.v < y.v GROUP BY ALL),
 r AS (SELECT layer, a, b, sum(n * (n - 1) / 2) AS r FROM (SELECT layer, a, b, s, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL), k AS (SELECT layer, a, b, sum(n * (n - 1) / 2) AS k FROM (SELECT layer, a, b, t, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
 g AS (SELECT layer, a, b, sum(n * (n - 1) / 2) AS g, sum(n) AS n FROM c GROUP BY ALL)
SELECT layer, a, b, round((g - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 6) AS ari FROM g JOIN r USING (layer, a, b) JOIN k USING (layer, a, b)"""


@query(sql(_VARIANTS, "states", "means"))
def a13_variants(spark, d):
    """Agreement of every pair of variants of the assignment, per layer."""
    s, c = fx.states(spark, d), fx.centers(spark, d)
    unit, whitened = ([{"step": "l2"}], [STANDARD])
    made = {"plain": distances.nearest(s, c), "refit": distances.nearest(s, fx.means(spark, d)), "cosine": distances.nearest(s, c, "cosine")}
    for name, steps in (("unit", unit), ("standardised", whitened)):
        t = Chain(steps).fit(s)
        made[name] = distances.nearest(t.transform(s), t.transform(c.withColumnRenamed("mu", "x")).withColumnRenamed("x", "mu"))
    labels = {n: r.select("row_id", "layer", F.col("state").alias(n)) for n, r in made.items()}
    wide = reduce(lambda a, b: a.join(b, ["row_id", "layer"]), labels.values())
    names = list(labels)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("la"), F.col(b).alias("lb")) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = wide.select("layer", F.explode(F.array(*pairs)).alias("p")).select("layer", "p.*")
    return cluster.rand_by(each, ["layer", "a", "b"], "la", "lb").select("layer", "a", "b", r6("ari"))


@query()
def g14_uniform_control(spark, d):
    """Centres of rows dealt out at random, matched with the fitted ones: five repeats."""
    c = fx.means(spark, d)
    k = c.groupBy("layer").agg(F.count("*").alias("k"))
    s = fx.states(spark, d).join(k, "layer").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4))))
    s = s.withColumn("b", F.floor(uniform("deal", F.col("rep"), F.col("layer"), F.col("row_id")) * F.col("k")).cast("int"))
    g = s.select("rep", "layer", "b", F.posexplode("x").alias("i", "v")).groupBy("rep", "layer", "b", "i").agg(F.avg("v").alias("v"))
    g = g.groupBy("rep", "layer", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("y"))
    sims = c.withColumnRenamed("state", "a").join(g, "layer").select("layer", "rep", "a", "b", A.cosine(F.col("mu"), F.col("y")).alias("sim"))
    m = align.optimal(sims, -1.0, allow_negative=True, by=("layer", "rep"))
    return m.groupBy("layer", "rep").agg(F.avg(1 - F.col("sim")).alias("x")).groupBy("layer").agg(r6(F.avg("x"), "distance"), F.count("*").alias("repeats"))


def _paths(spark, d):
    """Codes below each layer's size."""
    r = fx.routes(spark, d)
    sizes = [r_.k for r_ in r.groupBy("layer").agg((F.max("state") + 1).alias("k")).orderBy("layer").collect()]  # a row a layer
    return latent.paths(r), sizes


@query()
def r08_one_hot_pca(spark, d):
    """What four components of the one-hot routes of training rows leave of a route."""
    rows, sizes = _paths(spark, d)
    hot = F.concat(*(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda v, i=i: (F.col("z")[i] == v).cast("double")) for i, k in enumerate(sizes)))
    h = rows.select("row_id", F.lit(0).alias("layer"), hot.alias("x"))
    b = fits.packed(fits.bases(h.where(TRAIN), ["layer"], 4), ["layer"])
    x, m = F.col("x"), F.col("mean")
    back = fits.restored(fits.scores(x, m, F.col("basis")), m, F.col("basis"))
    return h.where(TEST).join(b, "layer").select("row_id", r6(A.sq_dist(x, back) / F.size("x"), "error"))
