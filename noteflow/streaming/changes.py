"""Note folders whose files come, change and go: each run takes in what has changed since the last one.

The table keeps, beside each curated record, the name, time and length of the file it came from and the number of the
run that took it in. A run lists the folder (names, times and lengths; no content), compares that with the newest entry of
each name, and opens the files that are new or differ. What came before stays in the table as it was:
:func:`current` gives the newest record of each file that is still there, :func:`as_of` those of an earlier run.

A run appends its rows in one job. One that is lost leaves rows that the next run counts as taken in, or none; a run
repeated without changes writes nothing. The number of rows read of the table is one per file and run, without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import curate
from ..schemas import CURATED, conform
from ..sources import sinks
from ..sources.readers import clean_text
from ..sources.work import written

_STATE = ("file", "modified", "length", "run", "gone")


def base_name(path: Column) -> Column:
    """Last part of a path; this source gives paths as they are, not URL-encoded."""
    return F.element_at(F.split(path, "/"), -1)


def _files(spark: SparkSession, folder: str, pattern: str, nested: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(nested).lower()).load(folder)


def ingest_changes(
    spark: SparkSession, folder: str, table: str, pattern: str = "*.txt", nested: bool = False, name=base_name
) -> dict[str, int]:
    """Take in the files of ``folder`` that are new, changed or gone; returns ``run, n_new, n_changed, n_gone``.

    ``name`` makes a file's name, by which it is known, from its path; ``nested`` looks into subfolders.
    """
    listed = _files(spark, folder, pattern, nested)
    # the content is not among the columns read here
    now = listed.select(name(F.col("path")).alias("file"), "path", F.col("modificationTime").alias("modified"), "length")
    now = written(now, "listing")
    known = _newest(spark.read.parquet(table)) if _exists(spark, table) else spark.createDataFrame([], _state_schema())
    known = known.select(*[F.col(c).alias(f"_{c}") for c in _STATE])
    same = (F.col("modified") == F.col("_modified")) & (F.col("length") == F.col("_length")) & ~F.col("_gone")
    met = now.join(known, F.col("file") == F.col("_file"), "full_outer")
    is_new = F.col("_file").isNull() | F.col("_gone")
    state = F.when(F.col("file").isNull(), F.when(~F.col("_gone"), "gone")).when(is_new, "new").when(~same, "changed")
    changes = written(met.withColumn("state", state).where("state IS NOT NULL"), "changes")
    counts = {r.state: r["count"] for r in changes.groupBy("state").count().collect()}
    run = (known.agg(F.max("_run").alias("r")).first()["r"] or 0) + 1
    told = {"run": run, **{f"n_{s}": counts.get(s, 0) for s in ("new", "changed", "gone")}}
    if not counts:
        return told

    rows = None
    opened = changes.where("state <> 'gone'")
    oldest = opened.agg(F.min("modified").alias("t")).first()["t"]
    if oldest is not None:
        # the filter on the time reaches the scan: files that are older are not opened
        recent = listed.where(F.col("modificationTime") >= F.lit(oldest)).select("path", "content")
        taken = recent.join(opened.select("path", "file", "modified", "length").hint("merge"), "path")
        raw = taken.select(clean_text(F.col("content").cast("string")).alias("raw_text"), F.col("file").alias("file_name"), "modified", "length")
        curated = curate(raw)
        rows = curated.select(
            *[F.col(c) for c in CURATED.names], F.col("file_name").alias("file"), "modified", "length",
            F.lit(run).alias("run"), F.lit(False).alias("gone"),
        )
    gone = changes.where("state = 'gone'").select(F.col("_file").alias("file"), F.col("_modified").alias("modified"), F.col("_length").alias("length"))
    gone = gone.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in CURATED.fields], "file", "modified", "length",
        F.lit(run).alias("run"), F.lit(True).alias("gone"),
    )
    rows = gone if rows is None else rows.unionByName(gone)
    rows.write.mode("append").parquet(table)
    return told


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest record of each file that is still there, as a curated table."""
    return as_of(spark, table, None)


def as_of(spark: SparkSession, table: str, run: int | None) -> DataFrame:
    """The table as it stood after ``run``; after the last one by default."""
    held = spark.read.parquet(table)
    held = held if run is None else held.where(F.col("run") <= run)
    newest = Window.partitionBy("file").orderBy(F.desc("run"), F.desc("modified"))
    # a file has a row for each of its versions
    kept = held.withColumn("_place", F.row_number().over(newest)).where("_place = 1 AND NOT gone")
    return conform(kept.select(*CURATED.names), CURATED)


def _newest(held: DataFrame) -> DataFrame:
    """The last state of every file; reads no texts."""
    last = held.groupBy("file").agg(F.max(F.struct("run", "modified", "length", "gone")).alias("s"))
    return last.select("file", "s.modified", "s.length", "s.run", "s.gone")


def _state_schema() -> str:
    return "file string, modified timestamp, length long, run int, gone boolean"


def _exists(spark: SparkSession, table: str) -> bool:
    return sinks.is_complete(spark, table)
