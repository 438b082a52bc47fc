"""The batch job: notes to curated table, serving set and vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import records, retrieval
from ..sources import generator, readers, sinks


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


def run_batch(
    spark: SparkSession,
    notes_folder: str,
    out_folder: str,
    knowledge_folder: str | None = None,
    fmt: str = "parquet",
    embedder=None,
) -> dict[str, int]:
    """Run the whole job and return its counts.

    The notes are scanned once. All counts ride along with the writes, and the
    serving set is read back from the curated table, where the filter and the
    column choice reach the scan.
    """
    return run_batch_on(
        readers.read_notes(spark, notes_folder),
        out_folder,
        readers.read_knowledge(spark, knowledge_folder) if knowledge_folder else None,
        fmt,
        embedder,
    )


def run_batch_on(
    notes: DataFrame,
    out_folder: str,
    knowledge: DataFrame | None = None,
    fmt: str = "parquet",
    embedder=None,
) -> dict[str, int]:
    spark = notes.sparkSession
    label = F.col("confidence_label")
    curated_counts, serving_counts = Observation(), Observation()

    curated = records.curate(notes).observe(
        curated_counts,
        _count("n_notes"),
        F.count("patient_id").alias("n_with_id"),
        F.count_if(label == "HIGH").alias("n_high"),
        F.count_if(label == "MEDIUM").alias("n_medium"),
        F.count_if(label == "LOW").alias("n_low"),
    )
    table = f"{out_folder}/curated"
    sinks.write_curated(curated, table, fmt)

    written = readers.read_curated(spark, table, fmt)
    scoreable = records.scoreable_only(written).observe(serving_counts, _count("n_serving"))
    sinks.write_serving(scoreable, f"{out_folder}/serving")
    counts = {**curated_counts.get, **serving_counts.get}

    if knowledge is not None:
        chunk_counts = Observation()
        vectors = retrieval.vector_table(knowledge, embedder)
        sinks.write_vectors(vectors.observe(chunk_counts, _count("n_chunks")), f"{out_folder}/vectors")
        counts.update(chunk_counts.get)
    return counts


def ensure_batch(spark: SparkSession, notes_folder: str, out_folder: str, **options) -> bool:
    """Run the job unless its outputs are there; True when it ran. Safe to repeat."""
    wanted = ["curated", "serving"] + (["vectors"] if options.get("knowledge_folder") else [])
    if all(sinks.is_complete(spark, f"{out_folder}/{name}") for name in wanted):
        return False
    run_batch(spark, notes_folder, out_folder, **options)
    return True


def ensure_notes(spark: SparkSession, notes_folder: str, count: int = 50, seed: int = 0) -> bool:
    """Write ``count`` synthetic notes unless the folder holds notes; True when written."""
    try:
        readers.read_notes(spark, notes_folder)
        return False
    except (FileNotFoundError, ValueError):
        generator.write_note_files(generator.generate_notes(spark, count, seed), notes_folder)
        return True
