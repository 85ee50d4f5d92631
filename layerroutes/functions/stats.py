"""Statistics that several operators share. Global orders never run in one task: values are
counted first, and running sums go over value ranges with offsets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.functions.arrays import let
from layerroutes.functions.hashing import digits
from layerroutes.sources.scratch import cut as stored

QUANTILES, PARTS = 32, 32


def running(df: DataFrame, by: list[str], order: str, cols: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` with a column for each of ``cols`` (new name: summed column): the sum over rows
    at or before this one in the order, within ``by``. The order is cut at approximate quantiles
    and each stretch between them into equal parts, so that neither an outlier nor a dense spot
    puts most rows into one; a part has a window of its own, and parts have theirs over one row
    each.

    Rows are read three times, so they are stored once. The cuts are stored too: approximate
    quantiles depend on the order in which their parts arrive, and offsets and rows must have the
    same ones."""
    work = stored(df if by else df.withColumn("_all", F.lit(1)))
    by_ = by or ["_all"]
    v = F.col(order).cast("double")
    cuts = F.percentile_approx(v, [i / QUANTILES for i in range(1, QUANTILES)], 1000)
    ends = stored(work.groupBy(*by_).agg(F.concat(F.array(F.min(v)), cuts, F.array(F.max(v))).alias("_ends")))
    at = F.size(F.filter(F.slice("_ends", 2, QUANTILES - 1), lambda c: c < v))
    lo, hi = F.get("_ends", F.col("_q")), F.get("_ends", F.col("_q") + 1)
    part = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * PARTS), F.lit(PARTS - 1))).otherwise(0)
    cut = work.join(ends, by_).withColumn("_q", at).withColumn("_b", (F.col("_q") * PARTS + part).cast("int")).drop("_ends", "_q")
    sums = cut.groupBy(*by_, "_b").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in cols.items()))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    w = Window.partitionBy(*by_).orderBy(way("_b"))
    before = sums.select(*by_, "_b", *((F.sum(f"_s_{n}").over(w) - F.col(f"_s_{n}")).alias(f"_o_{n}") for n in cols))
    local = Window.partitionBy(*by_, "_b").orderBy(way(order))
    out = cut.withColumns({n: F.sum(c).over(local) for n, c in cols.items()}).join(before, [*by_, "_b"])
    out = out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in cols})
    return out.drop("_b", *(f"_o_{n}" for n in cols), *([] if by else ["_all"]))


def place(df: DataFrame, by: list[str], order: Column, name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row within ``by`` in ascending ``order``, a number
    whose values differ. A group of any size is ranked in parts."""
    ranked = running(df.withColumns({"_order": order, "_one": F.lit(1)}), by, "_order", {name: "_one"})
    return ranked.drop("_order", "_one")


def drawn_place(df: DataFrame, by: list[str], salt: str, ids: list[str], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row within ``by`` in the order of
    ``uniform(salt, *ids)``. Such numbers fill their range evenly, so it is cut into 256 equal
    parts without looking for quantiles, and nothing is stored. Rows and counts are dealt alike,
    so they merge: counts of many groups are no table to send to the driver."""
    drawn = df.withColumn("_order", digits(salt, *map(F.col, ids)))
    cut = drawn.withColumn("_b", F.substring("_order", 1, 2))
    w = Window.partitionBy(*by).orderBy("_b")
    before = cut.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")  # 256 rows a group
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_order"))
    return cut.withColumn(name, local).join(before.hint("merge"), [*by, "_b"]).withColumn(name, F.col(name) + F.col("_before")).drop("_order", "_b", "_before")


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q0, q1, ...): interpolated quantiles of ``value``, null left out. Distinct values are
    counted, their running counts give the two values around each position, and no group's
    values meet in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    run = running(counts, by, "_v", {"_upto": "_n"})
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    run = run.join(total, by) if by else run.join(F.broadcast(total))  # one row
    pick = []
    for i, q in enumerate(shares):
        at = q * (F.col("_all") - 1)
        for k, rank in (("lo", F.floor(at) + 1), ("hi", F.ceil(at) + 1)):
            here = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
            pick.append(F.max(F.when(here, F.col("_v"))).alias(f"_{k}{i}"))
    g = run.groupBy(*by).agg(F.max("_all").alias("_all"), *pick)
    part = lambda q: q * (F.col("_all") - 1) - F.floor(q * (F.col("_all") - 1))
    return g.select(*by, *((F.col(f"_lo{i}") + part(q) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i, q in enumerate(shares)))


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve per ``by``, ties counting half; null with one class only."""
    by = by or []
    w = F.lit(1.0) if weight is None else weight.cast("double")
    pos = F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos")
    neg = F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg")
    at = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_score")).agg(pos, neg)
    run = running(at, by, "_score", {"below": "neg"})
    sums = run.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("below") - 0.5 * F.col("neg"))).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    return sums.select(*by, (F.col("wins") / F.when(F.col("p") * F.col("n") > 0, F.col("p") * F.col("n"))).alias("auroc"), (F.col("p") * F.col("n")).alias("pairs"), "wins")


def entropy_bits(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def pairs2(c: Column) -> Column:
    return c * (c - 1) / 2


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labellings."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("c"))
    rows, cols = (cells.groupBy(k).agg(F.sum("c").alias("c")) for k in (a, b))
    n = cells.agg(F.sum(pairs2(F.col("c"))).alias("sc"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("lc"))
    r, c = (x.agg(F.sum(pairs2(F.col("c"))).alias(f"s{i}"), F.sum(F.col("c") * F.log("c")).alias(f"l{i}")) for i, x in enumerate((rows, cols)))
    all_ = n.crossJoin(r).crossJoin(c)  # one row each
    exp = F.col("s0") * F.col("s1") / pairs2(F.col("n"))
    top = (F.col("s0") + F.col("s1")) / 2 - exp
    ari = F.when(top == 0, 1.0).otherwise((F.col("sc") - exp) / F.when(top != 0, top))
    h = [F.log("n") - F.col(f"l{i}") / F.col("n") for i in (0, 1)]
    mi = h[0] + h[1] - (F.log("n") - F.col("lc") / F.col("n"))
    return all_.select(ari.alias("ari"), F.when(h[0] + h[1] > 0, 2 * mi / (h[0] + h[1])).otherwise(1.0).alias("nmi"))


def log_factorial(n: Column) -> Column:
    """ln n!, by the product up to 20 and Stirling's series beyond (error below 1e-14)."""
    x = F.greatest(n, F.lit(1)).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def adjusted_information(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, mi, expected, ami): mutual information in nats of two labellings, its mean over all
    pairings with the same margins, and the adjusted value (arithmetic mean of the entropies).

    The mean is a hypergeometric sum for each pair of margins; equal pairs are summed once. A
    sum runs over counts within twelve standard deviations (and twelve) of its centre: beyond
    them the chance is below 1e-30."""
    by = by or []
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("m"))
    side = lambda k, n: cells.groupBy(*by, k).agg(F.sum("m").alias(n))
    left, right = side(a, "x"), side(b, "y")
    total = cells.groupBy(*by).agg(F.sum("m").alias("n"))
    with_n = (lambda t: t.join(total, by)) if by else (lambda t: t.join(F.broadcast(total)))  # one row
    m, x, y, n, k = (F.col(c) for c in "mxynk")
    mi = with_n(cells.join(left, [*by, a]).join(right, [*by, b])).groupBy(*by).agg(F.sum(m / n * F.log(n.cast("double") * m / (x.cast("double") * y))).alias("mi"), F.max("n").alias("n"))
    entropy = lambda t, c, name: with_n(t).groupBy(*by).agg(F.sum(-F.col(c) / n * F.log(F.col(c) / n)).alias(name), F.count("*").alias(f"{name}_k"))
    margins = lambda t, c: t.groupBy(*by, c).agg(F.count("*").alias(f"n{c}"))
    pairs = margins(left, "x").join(margins(right, "y"), by) if by else margins(left, "x").crossJoin(margins(right, "y"))  # distinct margins
    real = lambda c: c.cast("double")  # noqa: E731 - products of four counts leave the long ones
    mean, var = real(x) * y / n, real(x) * y * (n - x) * (n - y) / (real(n) * n * F.greatest(n - 1, F.lit(1)))
    far = 12 * F.sqrt(var) + 12
    low = F.greatest(F.lit(1), x + y - n, F.floor(mean - far)).cast("long")
    high = F.least(x, y, F.ceil(mean + far)).cast("long")
    terms = with_n(pairs).withColumn("k", F.explode(F.sequence(low, F.greatest(low, high)))).where(k <= F.least(x, y))
    choose = lambda p, q: log_factorial(p) - log_factorial(q) - log_factorial(p - q)
    chance = F.exp(choose(y, k) + choose(n - y, x - k) - choose(n, x))
    expected = terms.groupBy(*by).agg(F.sum(real(F.col("nx")) * F.col("ny") * chance * k / n * F.log(real(n) * k / (real(x) * y))).alias("expected"))
    parts = [mi, expected, entropy(left, "x", "ha"), entropy(right, "y", "hb")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.join(F.broadcast(p))  # one row each
    one = (F.col("ha_k") == F.col("hb_k")) & F.col("ha_k").isin(1) | (F.col("ha_k") == n) & (F.col("hb_k") == n)
    room = (F.col("ha") + F.col("hb")) / 2 - F.col("expected")
    ami = F.when(one, 1.0).otherwise((F.col("mi") - F.col("expected")) / F.when(F.abs(room) < 2.2e-16, F.signum(room) * 2.2e-16).otherwise(room))
    return out.select(*by, "mi", "expected", ami.alias("ami"))


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal is above ``z`` (0 or more): by the series of the
    distribution function, and beyond 5 by the continued fraction of the tail."""
    pdf = F.exp(-z * z / 2) / 2.5066282746310002
    step = lambda a, k: a["t"] * z * z / (2 * k + 1)
    start = F.struct(z.alias("t"), z.alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, lambda a, k: F.struct(step(a, k).alias("t"), (a["s"] + step(a, k)).alias("s")), lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / a)
    return F.when(z < 5, 0.5 - pdf * series).otherwise(pdf / fraction)


def mann_whitney(df: DataFrame, value: str, label: str, by: list[str]) -> DataFrame:
    """Two-sided p-value of the rank-sum test per ``by``: normal approximation with the tie
    term and continuity correction. Columns u (of label 1) and p, null with one class only."""
    one = (F.col(label) == 1).cast("double")
    at = df.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(one).alias("_p"), F.count("*").cast("double").alias("_t"))
    run = running(at, by, "_v", {"_upto": "_t"})
    t, n1, n = F.col("_t"), F.col("n1"), F.col("n")
    g = run.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_upto") - (t - 1) / 2)).alias("_r"), F.sum("_p").alias("n1"), F.sum("_t").alias("n"), F.sum(t * t * t - t).alias("_ties"))
    n0 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n0 / 2) - 0.5, F.lit(0.0)) / sd
    return g.where(n1 * n0 > 0).select(*by, u.alias("u"), z.alias("z"), F.least(F.lit(1.0), 2 * normal_tail(z)).alias("p"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x over 0: ten steps up, then Stirling's series."""
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, k: a + F.log(x + k))
    z = x + 10
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - steps


def t_two_sided(t: Column, df: Column) -> Column:
    """Chance that Student's t with ``df`` degrees of freedom is farther from 0 than ``t``: the
    incomplete beta function at df / (df + t^2), by its continued fraction on the side where it
    converges fast."""
    a, x = df / 2, df / (df + t * t)

    def fraction(p: Column, q: Column, y: Column) -> Column:
        tiny = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

        def once(s: Column, term: Column) -> Column:
            s = let(s, lambda s: F.struct(tiny(1 + term / s["c"]).alias("c"), (1 / tiny(1 + term * s["d"])).alias("d"), s["h"].alias("h")))
            return let(s, lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h")))

        def two(s: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return once(once(s, even), odd)

        d = 1 / tiny(1 - (p + q) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)).cast("array<double>"), start, two, lambda s: s["h"])

    half = F.lit(0.5)
    front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5723649429247001 + a * F.log(x) + 0.5 * F.log(1 - x))
    low = front / a * fraction(a, half, x)
    high = 1 - front / half * fraction(half, a, 1 - x)
    return F.when(t == 0, 1.0).when(x < (a + 1) / (a + 2.5), low).otherwise(high)
