"""Sinks, all distributed: the curated table, the serving set, the vector table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import serving_set
from ..schemas import CURATED, VECTOR, conform


def write_curated(curated: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All records, all columns, full overwrite. ``fmt`` may be ``delta`` where its jar is.

    Parquet files carry a Bloom filter of the patient ids, so that looking up one
    patient opens few of them.
    """
    writer = conform(curated, CURATED).write.format(fmt).mode("overwrite")
    if fmt == "parquet":
        writer = writer.option("parquet.bloom.filter.enabled#patient_id", "true")
    writer.save(path)


def pack_notes(spark: SparkSession, path: str, notes: Callable[[], DataFrame]) -> bool:
    """Pack ``notes()``, a scan of many small files, into few Parquet files of about equal size, once; True when packed.

    Adaptive execution merges what is small and cuts what is large, so the files' sizes do not follow the
    scan's tasks. Each note keeps its name and its length in characters.
    """

    def pack() -> None:
        packed = notes().select("raw_text", "file_name", F.length("raw_text").cast("long").alias("length"))
        packed.hint("rebalance").write.mode("overwrite").parquet(path)

    return materialise_once(spark, path, pack)


def write_serving(curated: DataFrame, path: str) -> None:
    """Scoreable records as JSON lines, NULL written out."""
    serving_set(curated).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    conform(vectors, VECTOR).write.mode("overwrite").parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its success marker, or a first Delta commit, under ``path``."""
    markers = ("_SUCCESS", "_delta_log/00000000000000000000.json")
    places = [spark._jvm.org.apache.hadoop.fs.Path(path, m) for m in markers]
    return any(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in places)


def materialise_once(spark: SparkSession, path: str, build: Callable[[], None]) -> bool:
    """Run ``build`` unless ``path`` holds a finished output; True when it ran.

    A half-written folder of a lost job has no success marker and is built again.
    """
    if is_complete(spark, path):
        return False
    build()
    return True


def write_text_files(texts: DataFrame, folder: str) -> bool:
    """Write each ``value`` and a line end to the file ``path`` below ``folder``, from the executors; paths are unique.

    Only into a folder that all executors have mounted; False, and nothing written, if it is in another store.
    Hadoop's local file system starts a process for each file it makes, to set its rights, and a commit moves
    them one by one on the driver. A file appears under its name only when whole.
    """
    spark = texts.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        return False
    root = place.toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n = set(), 0
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                target = os.path.join(root, path)
                parent, name = os.path.split(target)
                if parent not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                partial = os.path.join(parent, f".{name}.{uuid.uuid4().hex}")
                with open(partial, "wb") as out:
                    out.write((value or b"") + b"\n")
                os.replace(partial, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    texts.select("path", F.col("value").cast("binary").alias("value")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return True
