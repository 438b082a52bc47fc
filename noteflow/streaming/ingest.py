"""Incremental ingest: files that arrive become curated records exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import curate
from ..schemas import CURATED, conform
from ..sources import sinks


#: Name of the counts that a micro-batch leaves in its progress.
COUNTS = "curated"


def start_curated_stream(notes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Curate every note not seen before and append it to ``table``, then stop.

    ``notes`` is a stream of raw notes. The steps are those of the batch job and
    hold no state. Offsets and the sink's file log live under ``checkpoint`` and
    ``table``, so a lost or repeated run neither drops nor doubles a note. A file
    rewritten under its old name is not read again; :mod:`changes` takes such files in.
    Each micro-batch's counts are in its progress, under ``COUNTS``.
    """
    label = F.col("confidence_label")
    curated = conform(notes.transform(curate), CURATED).observe(
        COUNTS,
        F.count(F.lit(1)).alias("n_notes"),
        F.count("patient_id").alias("n_with_id"),
        F.count_if(label == "HIGH").alias("n_high"),
        F.count_if(label == "MEDIUM").alias("n_medium"),
        F.count_if(label == "LOW").alias("n_low"),
        F.count_if("is_scoreable").alias("n_serving"),
    )
    return (
        curated.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_curated_stream(notes: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Run the stream until all present input is taken in; return the table."""
    start_curated_stream(notes, table, checkpoint).awaitTermination()
    return notes.sparkSession.read.schema(CURATED).parquet(table)


def run_counted_stream(notes: DataFrame, table: str, checkpoint: str, metrics: str) -> DataFrame:
    """Run the stream and keep one row of counts per micro-batch under ``metrics``; returns that table.

    The counts ride along with the write, so no note is read twice. Rows bear the batch's number: a batch that was
    told before a run was lost is told once. Progress is read while the stream runs, since it keeps the last
    ``spark.sql.streaming.numRecentProgressUpdates`` (100) only.
    """
    spark = notes.sparkSession
    query = start_curated_stream(notes, table, checkpoint)
    told: dict[int, tuple] = {}
    while True:
        ended = query.awaitTermination(5)
        for progress in query.recentProgress:
            counts = progress.observedMetrics.get(COUNTS)
            if counts is not None and progress.numInputRows:
                told[progress.batchId] = (progress.batchId, *(counts[name] for name in _NAMES))
        if ended:
            break
    names = ", ".join(f"{name} long" for name in ("batch", *_NAMES))
    rows = spark.createDataFrame(list(told.values()), names)
    if sinks.is_complete(spark, metrics):
        rows = rows.join(spark.read.parquet(metrics).select("batch"), "batch", "left_anti")
    rows.coalesce(1).write.mode("append").parquet(metrics)
    return spark.read.parquet(metrics)


_NAMES = ("n_notes", "n_with_id", "n_high", "n_medium", "n_low", "n_serving")
