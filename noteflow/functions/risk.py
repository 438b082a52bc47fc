"""Readmission risk, as column expressions.

Three rule sets exist and disagree on purpose; they are kept apart:

* points: seven factors with points, tiers from 7 and 3 points;
* guideline points: the same plus a middle age band and medium-risk diagnoses;
* signals: the same seven factors counted, tiers from 3 and 1 signals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def _diagnosis_in(names) -> str:
    """SQL: the lower-cased diagnosis contains one of ``names``; NULL reads as no."""
    tests = [f"contains(lower(diagnosis), '{name}')" for name in names]
    return f"coalesce({' OR '.join(tests)}, false)"


HIGH_RISK_DIAGNOSIS = _diagnosis_in(rules.HIGH_RISK_DIAGNOSES)
MEDIUM_RISK_DIAGNOSIS = _diagnosis_in(rules.MEDIUM_RISK_DIAGNOSES)

# Reason, points, and SQL condition of each risk factor. A missing value counts
# as zero or false, so a record without follow-up information has no follow-up.
FACTORS = (
    ("3+ prior admissions", 3, "coalesce(prior_admissions, 0) >= 3"),
    ("No follow-up appointment", 3, "NOT coalesce(has_follow_up, false)"),
    ("Lives alone", 2, "coalesce(lives_alone, false)"),
    ("Medication non-compliance", 2, "coalesce(non_compliant, false)"),
    ("Length of stay over 7 days", 2, "coalesce(length_of_stay, 0) > 7"),
    ("Age over 75", 2, "coalesce(age, 0) > 75"),
    ("High-risk diagnosis", 3, HIGH_RISK_DIAGNOSIS),
)
GUIDELINE_FACTORS = (
    ("Age 60 to 75", 1, "coalesce(age, 0) BETWEEN 60 AND 75"),
    ("Medium-risk diagnosis", 1, MEDIUM_RISK_DIAGNOSIS),
)


def _total(weighted) -> Column:
    return F.expr(" + ".join(f"if({condition}, {weight}, 0)" for weight, condition in weighted))


def points() -> Column:
    return _total((weight, condition) for _, weight, condition in FACTORS)


def guideline_points() -> Column:
    return _total((weight, condition) for _, weight, condition in FACTORS + GUIDELINE_FACTORS)


def signals() -> Column:
    return _total((1, condition) for _, _, condition in FACTORS)


def _tier(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def points_tier(score: Column) -> Column:
    return _tier(score, rules.POINTS_HIGH_FROM, rules.POINTS_MEDIUM_FROM)


def signals_tier(count: Column) -> Column:
    return _tier(count, rules.SIGNALS_HIGH_FROM, rules.SIGNALS_MEDIUM_FROM)


def reasons() -> Column:
    """Array of the risk factors that hold, in rule order."""
    held = ", ".join(f"if({condition}, '{reason}', null)" for reason, _, condition in FACTORS)
    return F.expr(f"array_compact(array({held}))")


def caveat(label: Column) -> Column:
    """How far a score may be trusted; NULL for a HIGH-confidence record."""
    return F.when(label == "LOW", rules.SCORE_CAVEATS["LOW"]).when(
        label == "MEDIUM", rules.SCORE_CAVEATS["MEDIUM"]
    )


def readmission_match() -> Column:
    """Struct (dx_key, rate_pct) of the matching diagnosis, NULL when none matches.

    The rate table is ten fixed rows, so it is a chain of conditions and not a
    join. Highest rate first, then name, decides when two names match.
    """
    ordered = sorted(rules.READMISSION_RATES, key=lambda kr: (-kr[1], kr[0]))
    branches = " ".join(
        f"WHEN contains(lower(diagnosis), '{key.lower()}')"
        f" THEN named_struct('dx_key', '{key}', 'rate_pct', {rate})"
        for key, rate in ordered
    )
    return F.expr(f"CASE {branches} END")


def bands() -> dict[str, Column]:
    """HIGH/MEDIUM/LOW indicator of each factor; NULL where the guideline gives no band."""
    prior, age, stay = F.col("prior_admissions"), F.col("age"), F.col("length_of_stay")
    return {
        "prior_band": F.when(prior >= 3, "HIGH").when(prior >= 1, "MEDIUM").when(prior == 0, "LOW"),
        "follow_up_band": F.when(F.col("has_follow_up"), "LOW").otherwise("HIGH"),
        "alone_band": F.when(F.col("lives_alone"), "HIGH"),
        "compliance_band": F.when(F.col("non_compliant"), "HIGH"),
        # A stay of exactly three days lies in no band of the guideline.
        "stay_band": F.when(stay > 7, "HIGH").when(stay >= 4, "MEDIUM").when(stay < 3, "LOW"),
        "age_band": F.when(age > 75, "HIGH").when(age >= 60, "MEDIUM").when(age < 60, "LOW"),
        "diagnosis_band": F.when(F.expr(HIGH_RISK_DIAGNOSIS), "HIGH").when(
            F.expr(MEDIUM_RISK_DIAGNOSIS), "MEDIUM"
        ),
    }
