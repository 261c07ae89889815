"""Blocks of vectors: groups of rows as one row each, the vectors as one matrix of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_of(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, "<f8").reshape(n, -1)


def packed(rows: DataFrame, keys: list[str], vector: str, order: str = "spike_id") -> DataFrame:
    """keys, ids and x (a matrix of doubles as bytes, in the order of the ids) of each group. A group's
    vectors reach Python as one array: an object for each of them would take many times their size."""

    @F.pandas_udf("binary")
    def matrix(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(g, "<f8").tobytes() for g in vectors])

    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_id"), F.col(vector).alias("_x")))).alias("_rows"))
    return held.select(*keys, F.transform("_rows", lambda r: r["_id"]).alias("ids"), matrix(F.flatten(F.transform("_rows", lambda r: r["_x"]))).alias("x"))
