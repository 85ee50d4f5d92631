"""Chains of fitted steps over layer vectors. A step is a dict: {"step": "standardise"},
{"step": "pca", "rank": r, "whiten": bool} or {"step": "l2"}."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerroutes.functions import arrays as A
from layerroutes.operators import fits

EPS = 1e-8


class Chain:
    """Steps in order; each is fitted on training rows as the steps before it leave them. A
    length step has no inverse, so a chain with one is refused where centres must map back."""

    def __init__(self, steps: list[dict], must_invert: bool = False):
        bad = [s["step"] for s in steps if s["step"] not in ("standardise", "pca", "l2")]
        if bad:
            raise ValueError(f"unknown steps: {bad}")
        if must_invert and any(s["step"] == "l2" for s in steps):
            raise ValueError("a chain with l2 cannot map centres back")
        self.steps, self.fitted = steps, []

    def fit(self, train: DataFrame) -> "Chain":
        self.fitted = []
        for s in self.steps:
            table = self._table(s, train)
            self.fitted.append(table)
            train = self._step(s, table, train)
        return self

    @staticmethod
    def _table(s: dict, train: DataFrame) -> DataFrame | None:
        if s["step"] == "pca":
            return fits.packed(fits.bases(train, ["layer"], s["rank"]), ["layer"])
        if s["step"] == "standardise":
            g = train.select("layer", F.posexplode("x").alias("i", "v")).groupBy("layer", "i").agg(F.avg("v").alias("m"), F.sqrt(F.var_pop("v") + EPS).alias("sd"))
            pick = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda e: e[c])
            return g.groupBy("layer").agg(pick("m").alias("mean"), pick("sd").alias("sd"))  # the width
        return None

    @staticmethod
    def _step(s: dict, table: DataFrame | None, rows: DataFrame, back: bool = False) -> DataFrame:
        x = F.col("x")
        if s["step"] == "l2":
            if back:
                raise ValueError("l2 has no inverse")
            return rows.withColumn("x", A.unit(x))
        if s["step"] == "pca":
            new = (fits.restored if back else fits.scores)(x, F.col("mean"), F.col("basis"), s.get("whiten", False))
        elif back:
            new = F.zip_with(F.zip_with(x, "sd", lambda a, b: a * b), "mean", lambda a, m: a + m)
        else:
            new = F.zip_with(A.minus(x, F.col("mean")), "sd", lambda a, b: a / b)
        return rows.join(table, "layer").withColumn("x", new).select(*rows.columns)

    def transform(self, rows: DataFrame) -> DataFrame:
        for s, t in zip(self.steps, self.fitted):
            rows = self._step(s, t, rows)
        return rows

    def inverse(self, rows: DataFrame) -> DataFrame:
        for s, t in zip(reversed(self.steps), reversed(self.fitted)):
            rows = self._step(s, t, rows, back=True)
        return rows
