"""The questions users ask, each as one query over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import records


# ---- filters ---------------------------------------------------------------

def by_confidence(curated: DataFrame, label: str) -> DataFrame:
    return curated.filter(F.col("confidence_label") == label)


def no_follow_up(curated: DataFrame) -> DataFrame:
    return curated.filter(~F.col("has_follow_up"))


def non_compliant(curated: DataFrame) -> DataFrame:
    return curated.filter("non_compliant")


def over_age_high_risk(scored: DataFrame, age: int = 75) -> DataFrame:
    return scored.filter((F.col("age") > age) & (F.col("risk_tier") == "HIGH"))


def quality_issues(curated: DataFrame, any_missing: bool = False) -> DataFrame:
    """Records below HIGH confidence; with ``any_missing``, all that miss a field.

    HIGH covers scores from 80, so a HIGH record may still miss one field.
    Run it on the curated table: the serving set has lost the LOW records.
    """
    if any_missing:
        return curated.filter(F.col("missing_fields") != "None")
    return curated.filter(F.col("confidence_label") != "HIGH")


def chf_no_follow_up(curated: DataFrame) -> DataFrame:
    return no_follow_up(curated).filter(F.lower("diagnosis").contains(rules.CHF_DIAGNOSIS))


# ---- counts ----------------------------------------------------------------

def confidence_counts(curated: DataFrame) -> DataFrame:
    return curated.groupBy("confidence_label").agg(F.count(F.lit(1)).alias("n_records"))


def risk_summary(scored: DataFrame) -> DataFrame:
    """Records per tier, and the total as the row ``TOTAL``."""
    return (
        scored.rollup("risk_tier")
        .agg(F.count(F.lit(1)).alias("n_patients"))
        .select(F.coalesce("risk_tier", F.lit("TOTAL")).alias("risk_tier"), "n_patients")
    )


def risk_crosstab(records_: DataFrame) -> DataFrame:
    """How the points tier and the signals tier of the same record agree."""
    both = records_.transform(records.with_points).transform(records.with_signals)
    return both.groupBy("risk_tier", "signal_tier").agg(F.count(F.lit(1)).alias("n_patients"))


def record_counts(curated: DataFrame) -> DataFrame:
    """One row of load counts: notes, extracted ids, scoreable and repeated ids.

    Repeated ids come from a count per id, so one id holding a third of all
    notes is folded before it is shuffled.
    """
    per_id = curated.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_scoreable").alias("n_scoreable")
    )
    known = F.col("patient_id").isNotNull()
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_notes"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_with_id"),
        F.coalesce(F.sum("n_scoreable"), F.lit(0)).alias("n_scoreable"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("n_repeated_ids"),
    )


# ---- top-k -----------------------------------------------------------------

def highest_risk(scored: DataFrame, limit: int | None = 5) -> DataFrame:
    """HIGH-tier records, most points first; ``limit=None`` keeps all of them."""
    ordered = scored.filter(F.col("risk_tier") == "HIGH").orderBy(
        F.desc("risk_points"),
        F.desc("completeness_score"),
        F.asc_nulls_last("patient_id"),
        *_tie_breakers(scored),
    )
    return ordered if limit is None else ordered.limit(limit)


def first_records(serving: DataFrame, n: int = rules.RECORDS_IN_PROMPT) -> DataFrame:
    """The first ``n`` records by patient id, as shown in a prompt."""
    return serving.orderBy(F.asc_nulls_last("patient_id"), *_tie_breakers(serving)).limit(n)


def _tie_breakers(df: DataFrame) -> list[str]:
    """Columns that order records of one patient: the file name, or else all columns."""
    if "file_name" in df.columns:
        return ["file_name"]
    return [c for c in df.columns if c != "patient_id"]


# ---- per patient -----------------------------------------------------------

def assessments(curated: DataFrame) -> DataFrame:
    """Tier, reasons, quality note and action of every record, plus one text of all four."""
    rated = (
        curated.transform(records.with_points)
        .transform(records.with_reasons)
        .transform(records.with_caveat)
        .transform(records.with_intervention)
    )
    reasons = F.array_join("risk_reasons", "; ")
    text = F.concat(
        F.lit("Risk level: "), F.col("risk_tier"),
        F.lit("\nRisk factors: "), F.when(reasons == "", "none").otherwise(reasons),
        F.lit("\nData quality: "), F.col("completeness_score").cast("int").cast("string"),
        F.lit("% complete. "), F.col("quality_warning"),
        F.lit("\nAction: "), F.col("action"),
    )
    return rated.withColumn("assessment", text)


def explain_patient(curated: DataFrame, patient_id: str) -> DataFrame:
    """Why one patient is rated as they are. The filter reaches the table scan."""
    return assessments(curated.filter(F.col("patient_id") == patient_id))
