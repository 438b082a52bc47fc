"""Helpers of the operators in this folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An output batch is handed on when it holds about so many bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a document row: rows equal in id and text share it.

    Joins on it also compare the id. Rows that repeat one id with other texts keep
    keys of their own, and a NULL id is a value like any other.
    """
    return F.xxhash64(F.col(doc_id), F.col(text))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened alike until no column of ``df`` has one of them, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"{n}_" for n in names)
    return list(names)


def unused(df: DataFrame, names: Iterable[str]) -> None:
    """Refuse names of new columns that ``df`` has already."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already, give other names")


def once(key: tuple, build: Callable[[], object]):
    """``build()``, kept for all later tasks of the same Python worker.

    Functions travel by value, so globals of this package start anew in each task.
    """
    kept = sys.modules.setdefault("_noteflow_kept", types.ModuleType("_noteflow_kept")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes | None]:
    """UTF-8 bytes of a text column, one value at a time."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py()


def batches(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``weigh`` gives the bytes of a row, roughly."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def lists(kind: pa.DataType, arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of numbers as one list column."""
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values).cast(kind))
