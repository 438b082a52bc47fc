"""The three risk rules and what hangs on them."""

from __future__ import annotations

import pytest
from helpers import RECORD, record, values

from noteflow.functions import rules
from noteflow.operators import records


def points(spark, **changed):
    return values(records.with_points(record(spark, **changed)), "risk_points", "risk_tier")[0]


def guideline(spark, **changed):
    df = records.with_guideline_points(record(spark, **changed))
    return values(df, "guideline_points", "guideline_tier")[0]


def signals(spark, **changed):
    return values(records.with_signals(record(spark, **changed)), "signal_count", "signal_tier")[0]


@pytest.mark.parametrize(
    "changed, expected",
    [
        ({}, (0, "LOW")),
        ({"prior_admissions": 2}, (0, "LOW")),
        ({"prior_admissions": 3}, (3, "MEDIUM")),
        ({"has_follow_up": False}, (3, "MEDIUM")),
        ({"has_follow_up": None}, (3, "MEDIUM")),
        ({"lives_alone": True}, (2, "LOW")),
        ({"non_compliant": True}, (2, "LOW")),
        ({"length_of_stay": 7}, (0, "LOW")),
        ({"length_of_stay": 8}, (2, "LOW")),
        ({"age": 75}, (0, "LOW")),
        ({"age": 76}, (2, "LOW")),
        ({"diagnosis": "COPD exacerbation"}, (3, "MEDIUM")),
        ({"diagnosis": "Acute Myocardial Infarction"}, (3, "MEDIUM")),
        ({"diagnosis": "severe SEPSIS"}, (3, "MEDIUM")),
        ({"diagnosis": None}, (0, "LOW")),
        ({"lives_alone": True, "non_compliant": True, "length_of_stay": 9}, (6, "MEDIUM")),
        ({"prior_admissions": 5, "lives_alone": True, "non_compliant": True}, (7, "HIGH")),
    ],
)
def test_points(spark, changed, expected):
    assert points(spark, **changed) == expected


def test_all_null_record(spark):
    empty = spark.createDataFrame([(None,) * 10], RECORD)
    assert values(records.with_points(empty), "risk_points", "risk_tier") == [(3, "MEDIUM")]
    assert values(records.with_signals(empty), "signal_count", "signal_tier") == [(1, "MEDIUM")]


@pytest.mark.parametrize(
    "changed, expected",
    [
        ({"age": 59}, 0),
        ({"age": 60}, 1),
        ({"age": 75}, 1),
        ({"age": 76}, 2),
        ({"diagnosis": "Type 2 Diabetes Mellitus"}, 1),
        ({"diagnosis": "Chronic Kidney Disease Stage 3"}, 1),
        ({"diagnosis": "CKD"}, 1),
        ({"diagnosis": "Pneumonia"}, 1),
        ({"diagnosis": "Sepsis"}, 3),
    ],
)
def test_guideline_points(spark, changed, expected):
    assert guideline(spark, **changed)[0] == expected


def test_rules_disagree_as_documented(spark):
    assert points(spark, age=80) == (2, "LOW")
    assert signals(spark, age=80) == (1, "MEDIUM")
    three = {"lives_alone": True, "non_compliant": True, "length_of_stay": 9}
    assert points(spark, **three) == (6, "MEDIUM")
    assert signals(spark, **three) == (3, "HIGH")
    assert signals(spark) == (0, "LOW")


def test_reasons_follow_the_points(spark):
    df = records.with_reasons(record(spark, age=80, has_follow_up=False, diagnosis="Sepsis"))
    assert values(df, "risk_reasons") == [
        (["No follow-up appointment", "Age over 75", "High-risk diagnosis"],)
    ]
    assert values(records.with_reasons(record(spark)), "risk_reasons") == [([],)]


@pytest.mark.parametrize("tier, action", rules.INTERVENTIONS)
def test_intervention(spark, tier, action):
    changed = {"HIGH": {"prior_admissions": 3, "has_follow_up": False, "age": 80},
               "MEDIUM": {"has_follow_up": False}, "LOW": {}}[tier]
    df = records.with_intervention(records.with_points(record(spark, **changed)))
    assert values(df, "risk_tier", "action") == [(tier, action)]


@pytest.mark.parametrize(
    "diagnosis, expected",
    [
        ("COPD exacerbation", ("COPD", 22)),
        ("Chronic Kidney Disease Stage 3", ("Chronic Kidney Disease", 16)),
        ("pneumonia with sepsis", ("Sepsis", 20)),
        ("Sprained ankle", (None, None)),
        (None, (None, None)),
    ],
)
def test_readmission_rate(spark, diagnosis, expected):
    df = records.with_readmission_rate(record(spark, diagnosis=diagnosis))
    assert values(df, "dx_key", "rate_pct") == [expected]


@pytest.mark.parametrize(
    "column, field, cases",
    [
        ("prior_band", "prior_admissions", {0: "LOW", 1: "MEDIUM", 2: "MEDIUM", 3: "HIGH", None: None}),
        ("age_band", "age", {59: "LOW", 60: "MEDIUM", 75: "MEDIUM", 76: "HIGH", None: None}),
        ("stay_band", "length_of_stay", {2: "LOW", 3: None, 4: "MEDIUM", 7: "MEDIUM", 8: "HIGH"}),
        ("diagnosis_band", "diagnosis", {"COPD": "HIGH", "Pneumonia": "MEDIUM", "Hip Fracture": None}),
        ("follow_up_band", "has_follow_up", {True: "LOW", False: "HIGH"}),
    ],
)
def test_bands(spark, column, field, cases):
    for value, band in cases.items():
        assert values(records.with_bands(record(spark, **{field: value})), column) == [(band,)]


def test_caveat(spark):
    df = spark.createDataFrame([("LOW",), ("MEDIUM",), ("HIGH",)], "confidence_label string")
    assert values(records.with_caveat(df), "score_caveat") == [
        ("not definitive",), ("approximate",), (None,)
    ]
