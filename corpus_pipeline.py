"""Documents to tokens in five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteflow.llm import byte_bpe, decontamination, language_id, line_dedup, simhash_dedup
from noteflow.sources.tables import table
from noteflow.sources.work import written


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that these documents teach; others and letterless ones go."""
    return language_id.accepted(docs, language_id.fit(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that a larger document of three or more holds too."""
    return line_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return simhash_dedup.deduplicate(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    return byte_bpe.digests(docs, ids=True)


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", repeated_lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_items),
    ("byte_bpe", tokens),
]

#: SQL can express neither the kernels, the fingerprints' hash nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
