"""Vectors as the searches of this folder take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows with a key whose vector holds one number at least and finite numbers only, of the most frequent length.

    Of lengths equally frequent the longer one counts.
    """
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = df.where(F.col(key).isNotNull() & (F.size(column) > 0) & F.coalesce(sound, F.lit(False)))
    width = held.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return held.where(F.size(column) == (width["width"] if width else 0))


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """A list column of equally long number lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def chosen(df: DataFrame, rows: int, n: int, *columns: str) -> DataFrame:
    """About ``rows`` of ``n`` rows, chosen by a hash of ``columns``, so the same ones at each run; all of them if fewer."""
    scale = 1 << 40
    least = scale if n <= rows else int(scale * rows / n)
    return df.where(F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(scale)) < least)
