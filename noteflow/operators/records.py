"""Notes to curated and scored records. Every step is row-local: no shuffle,
and the same functions serve batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extraction, quality, risk, rules
from ..schemas import EXTRACTED, QUALITY, SERVING
from .contains import best_contained


def extract_fields(
    notes: DataFrame,
    specs: Sequence[rules.FieldSpec] = rules.FIELD_SPECS,
    strict: bool = False,
) -> DataFrame:
    """Add the extracted columns to ``notes`` (needs ``raw_text``).

    Each regex runs once per note in the first projection; the second turns what
    was captured into typed values. These leave through ``inline`` of one struct,
    which keeps one row per note but stops the optimizer from copying the
    regexes into every later filter on an extracted column.
    Fields beyond the standard ten are appended in the order of ``specs``.
    """
    kept = notes.columns
    text = F.col("raw_text")
    found = notes.select(
        *kept,
        *[extraction.capture(text, s, strict).alias(extraction.capture_name(s)) for s in specs],
        F.lower(text).alias("_lowered"),
    )
    lowered = F.col("_lowered")
    values = extraction.typed_columns(specs)
    values["has_follow_up"] = extraction.follow_up(lowered)
    values["lives_alone"] = extraction.lives_alone(lowered)
    values["non_compliant"] = extraction.non_compliant(lowered)
    order = [c for c in EXTRACTED.names if c in values]
    order += [c for c in values if c not in order]
    record = F.struct(*[values[c].alias(c) for c in order])
    return found.select(*kept, F.inline(F.array(record)))


def add_quality(records: DataFrame) -> DataFrame:
    """Add completeness score, missing fields, confidence, scoreable flag and warning."""
    kept = records.columns
    score, missing = F.col("completeness_score"), F.col("missing_fields")
    label = F.col("confidence_label")
    return (
        records.withColumns(quality.presence(records))
        .select(
            *kept,
            quality.completeness().alias("completeness_score"),
            quality.missing_labels().alias("missing_fields"),
        )
        .select(
            *kept,
            "completeness_score",
            F.when(missing == "", "None").otherwise(missing).alias("missing_fields"),
            quality.confidence(score).alias("confidence_label"),
            quality.scoreable(score).alias("is_scoreable"),
        )
        .withColumn("quality_warning", quality.warning(label))
        .select(*kept, *QUALITY.names)
    )


def curate(notes: DataFrame) -> DataFrame:
    """Raw notes to curated records."""
    return notes.transform(extract_fields).transform(add_quality)


def scoreable_only(records: DataFrame) -> DataFrame:
    return records.filter("is_scoreable")


def serving_set(curated: DataFrame) -> DataFrame:
    """The thirteen serving columns of scoreable records."""
    return scoreable_only(curated).select(*SERVING.names)


def with_points(records: DataFrame) -> DataFrame:
    """Add ``risk_points`` and ``risk_tier``, the default risk rule."""
    return records.withColumn("risk_points", risk.points()).withColumn(
        "risk_tier", risk.points_tier(F.col("risk_points"))
    )


def with_guideline_points(records: DataFrame) -> DataFrame:
    return records.withColumn("guideline_points", risk.guideline_points()).withColumn(
        "guideline_tier", risk.points_tier(F.col("guideline_points"))
    )


def with_signals(records: DataFrame) -> DataFrame:
    return records.withColumn("signal_count", risk.signals()).withColumn(
        "signal_tier", risk.signals_tier(F.col("signal_count"))
    )


def with_reasons(records: DataFrame) -> DataFrame:
    return records.withColumn("risk_reasons", risk.reasons())


def with_bands(records: DataFrame) -> DataFrame:
    return records.withColumns(risk.bands())


def with_caveat(records: DataFrame) -> DataFrame:
    return records.withColumn("score_caveat", risk.caveat(F.col("confidence_label")))


def with_readmission_rate(records: DataFrame) -> DataFrame:
    """Add ``dx_key`` and ``rate_pct``; one row stays one row."""
    return (
        records.withColumn("_match", risk.readmission_match())
        .withColumns({"dx_key": F.col("_match.dx_key"), "rate_pct": F.col("_match.rate_pct")})
        .drop("_match")
    )


def with_rate_from(records: DataFrame, rates: DataFrame, text: str = "diagnosis") -> DataFrame:
    """Add ``dx_key`` and ``rate_pct`` from a table of rates of any size: the highest rate whose key ``text`` contains.

    Keys are found by their rarest gram, so nothing is compared with every row of ``rates``.
    """
    return best_contained(records, text, rates, "dx_key", "rate_pct")


def interventions(spark) -> DataFrame:
    """The three fixed (risk_tier, action) rows, as a local relation."""
    rows = ", ".join(f"('{tier}', '{action}')" for tier, action in rules.INTERVENTIONS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(risk_tier, action)")


def with_intervention(scored: DataFrame) -> DataFrame:
    """Add ``action`` by tier. The dimension has three fixed rows, so it is broadcast."""
    dim = interventions(scored.sparkSession)
    return scored.join(F.broadcast(dim), "risk_tier", "left")
