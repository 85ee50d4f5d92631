"""Functions of the user's own: where vectors come from, what is computed from routes, and which
K a scan chooses. Each is called with plain frames and its answer is checked."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from layerroutes.sources.tables import write_trial


def states_from(rows: DataFrame, layers: list[int], f: Callable[[int, pd.DataFrame], np.ndarray], ident: str = "row_id", fields: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """(ident, layer, x, ``fields``) from a function of a layer and a batch of ``rows``.

    ``f`` gets the batch as a frame and gives a matrix with a row for each of its rows, in order.
    A matrix of another shape, numbers that are not finite, or a width other than ``width`` (of
    the first matrix of the batch, if not given) is an error. Batches are Arrow's; choose the
    rows (a subset of ids, columns) before. ``fields`` are carried along unchanged."""
    if not layers or len(set(layers)) != len(layers):
        raise ValueError(f"layers must be given once each: {layers}")
    keep = [ident, *fields]
    schema = T.StructType([rows.schema[ident], T.StructField("layer", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())), *(rows.schema[c] for c in fields)])

    def run(frames):
        for frame in frames:
            wide = width
            for layer in layers:
                x = np.asarray(f(layer, frame), dtype=np.float64)
                if x.ndim != 2 or len(x) != len(frame):
                    raise ValueError(f"layer {layer}: {len(frame)} rows need a matrix of as many, not {x.shape}")
                wide = x.shape[1] if wide is None else wide
                if x.shape[1] != wide or not np.isfinite(x).all():
                    raise ValueError(f"layer {layer}: vectors must be finite and {wide} wide")
                yield frame[keep].assign(layer=layer, x=list(x))[[ident, "layer", "x", *fields]]

    return rows.mapInPandas(run, schema)


def analyse(prepared: DataFrame, f: Callable[[DataFrame], DataFrame | dict[str, DataFrame]], path: str | None = None, trial_id: str | None = None) -> dict[str, DataFrame]:
    """The tables that the user's function makes of prepared rows (routes beside labels): one
    frame becomes the table ``result``. With a path they are stored as tables of a trial and
    read back, so that later reads do not compute again."""
    made = f(prepared)
    tables = {"result": made} if isinstance(made, DataFrame) else dict(made)
    for name, df in tables.items():
        if not isinstance(df, DataFrame):
            raise TypeError(f"table {name} is no DataFrame")
        if len({c.lower() for c in df.columns}) != len(df.columns):
            raise ValueError(f"table {name} repeats a column: {df.columns}")
    if path is None:
        return tables
    if not trial_id:
        raise ValueError("stored tables need a trial_id")
    write_trial(tables, path, trial_id)
    spark = prepared.sparkSession
    return {name: spark.read.parquet(f"{path}/{name}").where(f"trial_id = '{trial_id}'").drop("trial_id").select(*df.columns) for name, df in tables.items()}


def select_k(scan: DataFrame, f: Callable[[pd.DataFrame], int], layer: str = "layer", k: str = "k") -> DataFrame:
    """(layer, k): the K that the user's function picks from each layer's scan table, which it
    gets sorted by K. A K that was not tried is an error."""
    schema = T.StructType([scan.schema[layer], T.StructField(k, T.IntegerType())])

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        picked = int(f(frame.sort_values(k).reset_index(drop=True)))
        if picked not in set(frame[k]):
            raise ValueError(f"layer {key[0]}: K of {picked} was not tried")
        return pd.DataFrame([(key[0], picked)], columns=[layer, k])

    return scan.groupBy(layer).applyInPandas(one, schema)  # a scan table has a row a K
