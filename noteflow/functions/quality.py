"""Completeness, confidence and warning of a record, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules


def presence_name(field: str) -> str:
    return f"_has_{field}"


def presence(records: DataFrame) -> dict[str, Column]:
    """One never-NULL flag per weighted field: neither NULL nor, for a string, blank."""
    flags = {}
    for field, _, _ in rules.FIELD_WEIGHTS:
        is_string = isinstance(records.schema[field].dataType, StringType)
        test = f"coalesce(trim({field}) <> '', false)" if is_string else f"{field} IS NOT NULL"
        flags[presence_name(field)] = F.expr(test)
    return flags


def completeness() -> Column:
    """Sum of the weights of present fields, over the flags of :func:`presence`."""
    parts = [f"if({presence_name(f)}, {weight}D, 0D)" for f, weight, _ in rules.FIELD_WEIGHTS]
    return F.expr(f"round({' + '.join(parts)}, 1)")


def missing_labels() -> Column:
    """Labels of absent fields, comma-joined; ``''`` for a complete record."""
    parts = [f"if({presence_name(f)}, null, '{label}')" for f, _, label in rules.FIELD_WEIGHTS]
    return F.expr(f"concat_ws(', ', {', '.join(parts)})")


def confidence(score: Column) -> Column:
    return (
        F.when(score >= rules.HIGH_CONFIDENCE_FROM, "HIGH")
        .when(score >= rules.SCOREABLE_FROM, "MEDIUM")
        .otherwise("LOW")
    )


def scoreable(score: Column) -> Column:
    return F.coalesce(score >= rules.SCOREABLE_FROM, F.lit(False))


def warning(label: Column) -> Column:
    return (
        F.when(label == "LOW", rules.QUALITY_WARNINGS["LOW"])
        .when(label == "MEDIUM", rules.QUALITY_WARNINGS["MEDIUM"])
        .otherwise(rules.QUALITY_WARNINGS["HIGH"])
    )
