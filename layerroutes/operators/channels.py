"""Effects of single coordinates (channels) between two classes, found on discovery rows and
repeated on test rows.

Rows are (row_id, layer, x, y, train, clean): y 0 or 1, train true for discovery, clean for test
rows that count in the clean repeat. One pass over the exploded coordinates adds up all subsets."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.functions.stats import t_two_sided
from layerroutes.operators import fits


def _moments(name: str, v: Column, when: Column) -> list[Column]:
    out = []
    for y in (0, 1):
        own = F.when(when & (F.col("y") == y), v)
        out += [F.count(own).alias(f"{name}_n{y}"), F.avg(own).alias(f"{name}_m{y}"), F.var_samp(own).alias(f"{name}_v{y}")]
    return out


def effect(name: str) -> tuple[Column, Column]:
    """Pooled effect size and two-sided Welch p-value from the columns of ``_moments``; without
    spread the effect is 0 and p is 1."""
    n0, n1, m0, m1, v0, v1 = (F.col(f"{name}_{c}{y}") for c in "nmv" for y in (0, 1))
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))
    s0, s1 = v0 / n0, v1 / n1
    t = F.when(s0 + s1 > 1e-24, (m1 - m0) / F.sqrt(s0 + s1)).otherwise(0.0)
    df = F.greatest((s0 + s1) * (s0 + s1) / F.greatest(s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1), F.lit(1e-30)), F.lit(1.0))
    return F.when(pooled > 1e-12, (m1 - m0) / pooled).otherwise(0.0), F.coalesce(t_two_sided(t, df), F.lit(1.0))


def _long(rows: DataFrame, *keep: str) -> DataFrame:
    size = F.greatest(F.sqrt(A.dot(F.col("x"), F.col("x")) / F.size("x")), F.lit(1e-12))
    return rows.withColumn("size", size).select("layer", "y", "train", *keep, "size", F.posexplode("x").alias("channel", "v"))


def channel_table(rows: DataFrame, middle: tuple[float, float] = (0.25, 0.75), massive: float = 10.0) -> DataFrame:
    """Per layer and channel: rms over discovery rows, its average rank as a share, the greatest
    size over the median rms, whether the channel is of the middle band and not massive, and effect
    and p-value on discovery rows, test rows, clean test rows and test rows of unit size."""
    train, v = F.col("train"), F.col("v")
    test = ~train
    subsets = {"discovery": (v, train), "test": (v, test), "clean": (v, test & F.col("clean")), "unit": (v / F.col("size"), test)}
    g = _long(rows, "clean").groupBy("layer", "channel").agg(
        F.sqrt(F.avg(F.when(train, v * v))).alias("rms"), F.max(F.when(train, F.abs(v))).alias("peak"), *(c for n, (x, when) in subsets.items() for c in _moments(n, x, when)))
    w = Window.partitionBy("layer")  # a row a channel
    ties = F.count("*").over(Window.partitionBy("layer", "rms"))
    share = (F.rank().over(w.orderBy("rms")) + (ties - 1) / 2) / F.count("*").over(w)
    g = g.withColumns({"rms_share": share, "peak_ratio": F.col("peak") / F.greatest(F.median("rms").over(w), F.lit(1e-12))})
    band = F.col("rms_share").between(*middle) & (F.col("peak_ratio") < massive)
    effects = [c for n in subsets for d, p in [effect(n)] for c in (d.alias(f"{n}_d"), p.alias(f"{n}_p"))]
    return g.select("layer", "channel", "rms", "rms_share", "peak_ratio", band.alias("middle"), *effects)


def chosen(table: DataFrame, top: int, by: str = "discovery_p") -> DataFrame:
    """(layer, channel): the ``top`` middle channels of least discovery p-value a layer."""
    w = Window.partitionBy("layer").orderBy(by, "channel")  # a row a channel
    return table.where("middle").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= top).select("layer", "channel")


def per_category(rows: DataFrame, channels: DataFrame, category: str) -> DataFrame:
    """Effects of the chosen channels on the test rows of each category."""
    t = _long(rows.where(~F.col("train")), category).join(channels, ["layer", "channel"])
    g = t.groupBy("layer", "channel", category).agg(*_moments("c", F.col("v"), F.lit(True)))
    d, p = effect("c")
    return g.select("layer", "channel", category, d.alias("d"), p.alias("p"), (F.col("c_n0") + F.col("c_n1")).alias("n"))


def over_layers(rows: DataFrame, channels: DataFrame, first: int) -> DataFrame:
    """Channels chosen in layer ``first``, followed through all layers over test rows: effect,
    and correlation of the values with those in ``first``."""
    own = channels.where(F.col("layer") == first).select("channel")
    t = _long(rows.where(~F.col("train")), "row_id").join(own, "channel")
    start = t.where(F.col("layer") == first).select("row_id", "channel", F.col("v").alias("v0"))
    g = t.join(start, ["row_id", "channel"]).groupBy("layer", "channel").agg(F.corr("v0", "v").alias("r"), *_moments("c", F.col("v"), F.lit(True)))
    return g.select("layer", "channel", effect("c")[0].alias("d"), "r", (F.col("c_n0") + F.col("c_n1")).alias("n"))


def updates(rows: DataFrame, channels: DataFrame, first: int) -> DataFrame:
    """Class differences of the change from each layer to the next, in channels chosen in
    ``first``, with a normal 95 % interval, and of the state itself."""
    own = channels.where(F.col("layer") == first).select("channel")
    t = _long(rows.where(~F.col("train")), "row_id").join(own, "channel")
    before = t.select("row_id", "channel", (F.col("layer") + 1).alias("layer"), F.col("v").alias("v0"))
    g = t.join(before, ["row_id", "channel", "layer"]).groupBy("layer", "channel").agg(*_moments("u", F.col("v") - F.col("v0"), F.lit(True)), *_moments("s", F.col("v"), F.lit(True)))
    delta = F.col("u_m1") - F.col("u_m0")
    half = 1.96 * F.sqrt(F.col("u_v1") / F.col("u_n1") + F.col("u_v0") / F.col("u_n0"))
    return g.select("layer", "channel", delta.alias("delta"), (delta - half).alias("low"), (delta + half).alias("high"), (F.col("s_m1") - F.col("s_m0")).alias("state_delta"))


def controlled(rows: DataFrame, nuisance: Column) -> DataFrame:
    """Per layer and channel: correlation with y of what nuisances leave, on discovery and test
    rows, with p-values whose degrees of freedom count the nuisances. ``nuisance`` is an array of
    numbers a row; an intercept is added. Regressions use discovery rows alone.

    One pass adds up products of [1, nuisances, y, x] for each part; a layer's solve holds the
    square of that width."""
    q = rows.select(F.size(nuisance).alias("q")).first()
    if q is None:
        raise ValueError("no rows")
    q = q.q
    wide = rows.select("layer", "train", F.concat(nuisance, F.array(F.col("y").cast("double")), "x").alias("x"))
    products = fits.sums(wide, ["layer", "train"])

    def one(key, f: pd.DataFrame) -> pd.DataFrame:
        d = int(f["i"].max()) + 1
        m = {}
        for t, g in f.groupby("train"):
            m[bool(t)] = np.zeros((d, d))
            m[bool(t)][g["i"], g["j"]] = g["v"]
        c, rest = slice(0, q + 1), slice(q + 1, d)
        beta = np.linalg.lstsq(m[True][c, c], m[True][c, rest], rcond=1e-8)[0]
        # residuals are linear in the rows, so their products come from the rows' products
        left = np.vstack([-beta, np.eye(d - q - 1)])
        out = {"layer": key[0], "channel": range(d - q - 2)}
        for name, t in (("discovery", True), ("test", False)):
            if t not in m:
                out[f"{name}_r"], out[f"{name}_df"] = 0.0, 1.0
                continue
            n = m[t][0, 0]
            s, r = left.T @ m[t][0], left.T @ m[t] @ left
            cov = r - np.outer(s, s) / n
            den = np.sqrt(np.maximum(cov[0, 0] * np.diag(cov)[1:], 0))
            out[f"{name}_r"] = np.where(den > 1e-12, cov[0, 1:] / np.where(den > 1e-12, den, 1), 0.0)
            out[f"{name}_df"] = float(max(n - 2 - (q + 1), 1))
        return pd.DataFrame(out)

    got = products.groupBy("layer").applyInPandas(one, "layer int, channel int, discovery_r double, discovery_df double, test_r double, test_df double")
    p = lambda n: t_two_sided(F.col(f"{n}_r") * F.sqrt(F.col(f"{n}_df") / F.greatest(1 - F.col(f"{n}_r") * F.col(f"{n}_r"), F.lit(1e-15))), F.col(f"{n}_df"))
    return got.select("layer", "channel", "discovery_r", p("discovery").alias("discovery_p"), "test_r", p("test").alias("test_p"))
