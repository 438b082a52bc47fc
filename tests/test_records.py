"""Extraction and quality, case by case."""

from __future__ import annotations

import pytest
from helpers import note, notes, record, values

from noteflow.functions.rules import FIELD_SPECS, FieldSpec
from noteflow.operators import records
from noteflow.schemas import CURATED, EXTRACTED, SERVING


def extracted(spark, text, **options):
    return records.extract_fields(notes(spark, text), **options).collect()[0]


def curated(spark, *texts):
    return records.curate(notes(spark, *texts))


def test_complete_note(spark):
    row = curated(spark, note()).collect()[0]
    assert row.patient_id == "PAT-0001"
    assert row.age == 57
    assert row.gender == "Female"
    assert row.diagnosis == "Hip Fracture"
    assert row.length_of_stay == 5
    assert row.prior_admissions == 1
    assert row.medications_raw == "Aspirin 81mg, Warfarin 5mg"
    assert (row.has_follow_up, row.lives_alone, row.non_compliant) == (True, False, False)
    assert row.completeness_score == 100.0
    assert row.missing_fields == "None"
    assert row.confidence_label == "HIGH"
    assert row.is_scoreable
    assert row.quality_warning == "✅ Record complete. Risk score reliable."


def test_schemas(spark):
    df = curated(spark, note())
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in CURATED]
    served = records.serving_set(df)
    assert [(f.name, f.dataType) for f in served.schema] == [(f.name, f.dataType) for f in SERVING]


def test_absent_fields_are_null(spark):
    row = extracted(spark, "nothing to see")
    for name in EXTRACTED.names:
        expected = False if name in ("has_follow_up", "lives_alone", "non_compliant") else None
        assert row[name] == expected, name


@pytest.mark.parametrize(
    "changed, field, expected",
    [
        ({"age": "Age: Unknown"}, "age", None),
        ({"age": "Page: 9\nAge: 57"}, "age", 57),
        ({"age": "age: 57"}, "age", None),
        ({"age": "Age: 99999999999"}, "age", None),
        ({"stay": "Length of Stay: x days"}, "length_of_stay", None),
        ({"prior": "Prior Admissions: 4"}, "prior_admissions", 4),
        ({"prior": "Prior Admissions (last year, all wards): 12"}, "prior_admissions", 12),
        ({"id": "Patient ID: PAT-12345"}, "patient_id", "PAT-12345"),
        ({"id": "Patient ID: 12345"}, "patient_id", None),
        ({"dx": "Primary Diagnosis: Not Documented yet"}, "diagnosis", None),
        ({"dx": "Primary Diagnosis:  Sepsis \t"}, "diagnosis", "Sepsis"),
        ({"meds": "Medications at Discharge: See Pharmacy notes"}, "medications_raw", None),
        ({"rest": "Patient advised to follow up with cardiologist in 2 weeks."}, "has_follow_up", False),
        ({"rest": "No follow-up appointment scheduled at time of discharge."}, "has_follow_up", False),
        ({"rest": "FOLLOW-UP in 3 days"}, "has_follow_up", True),
        ({"rest": ""}, "has_follow_up", False),
        ({"rest": "No history of non-compliance."}, "non_compliant", True),
        ({"rest": "Patient LIVES ALONE."}, "lives_alone", True),
    ],
)
def test_field_rules(spark, changed, field, expected):
    assert extracted(spark, note(**changed))[field] == expected


def test_empty_label_takes_next_line_unless_strict(spark):
    text = note(dx="Primary Diagnosis: ")
    assert extracted(spark, text).diagnosis == "Length of Stay: 5 days"
    assert extracted(spark, text, strict=True).diagnosis is None


def test_label_at_end_of_note(spark):
    assert extracted(spark, "Primary Diagnosis:   \n").diagnosis is None


def test_own_field(spark):
    specs = (*FIELD_SPECS, FieldSpec("ward", "Ward:", r"\w+"))
    row = extracted(spark, note() + "\nWard: B7", specs=specs)
    assert row.ward == "B7"
    assert row.age == 57


def test_every_note_stays_one_row(spark):
    texts = [note(), "", note(), "x"]
    assert curated(spark, *texts).count() == 4


@pytest.mark.parametrize(
    "drop, score, label, missing",
    [
        ((), 100.0, "HIGH", "None"),
        (("age",), 80.0, "HIGH", "Age"),
        (("dx",), 75.0, "MEDIUM", "Primary Diagnosis"),
        (("dx", "stay", "meds"), 50.0, "MEDIUM", "Primary Diagnosis, Length of Stay, Medications"),
        (("age", "dx", "meds"), 45.0, "LOW", "Age, Primary Diagnosis, Medications"),
        (("gender",), 100.0, "HIGH", "None"),
    ],
)
def test_quality(spark, drop, score, label, missing):
    row = curated(spark, note(drop=drop)).collect()[0]
    assert row.completeness_score == score
    assert row.confidence_label == label
    assert row.missing_fields == missing
    assert row.is_scoreable == (score >= 50)


def test_blank_strings_count_as_missing(spark):
    df = records.add_quality(record(spark, diagnosis="  ", medications_raw=""))
    assert values(df, "completeness_score", "missing_fields") == [
        (65.0, "Primary Diagnosis, Medications")
    ]


def test_serving_set_drops_low_records(spark):
    df = curated(spark, note(), note(drop=("age", "dx", "meds")))
    assert records.serving_set(df).count() == 1


def test_same_patient_twice_stays_two_rows(spark):
    assert curated(spark, note(), note()).count() == 2
