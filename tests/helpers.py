"""Small builders shared by the tests."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

LINES = {
    "id": "Patient ID: PAT-0001",
    "age": "Age: 57",
    "gender": "Gender: Female",
    "dx": "Primary Diagnosis: Hip Fracture",
    "stay": "Length of Stay: 5 days",
    "prior": "Prior Admissions (past 12 months): 1",
    "meds": "Medications at Discharge: Aspirin 81mg, Warfarin 5mg",
    "rest": "Social support: Family present.\nFollow-up in 30 days with specialist.",
}


def note(drop=(), **changed) -> str:
    """A complete note; ``drop`` leaves lines out, keywords replace lines."""
    return "\n".join(text for name, text in {**LINES, **changed}.items() if name not in drop)


def notes(spark, *texts):
    rows = [(text, f"patient_{i:04d}.txt") for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "raw_text string, file_name string")


RECORD = (
    "patient_id string, age int, gender string, diagnosis string, length_of_stay int, "
    "prior_admissions int, has_follow_up boolean, lives_alone boolean, non_compliant boolean, "
    "medications_raw string"
)


def record(spark, **values):
    """One record in which nothing is a risk, but for ``values``."""
    calm = {
        "patient_id": "PAT-0001", "age": 50, "gender": "Male", "diagnosis": "Hip Fracture",
        "length_of_stay": 1, "prior_admissions": 0, "has_follow_up": True,
        "lives_alone": False, "non_compliant": False, "medications_raw": "Aspirin 81mg",
    }
    row = {**calm, **values}
    names = [c.split()[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names)], RECORD)


def plan(df, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def final_plan(df) -> str:
    """Physical plan after a run, as adaptive execution left it."""
    df.write.format("noop").mode("overwrite").save()
    executed = df._jdf.queryExecution().executedPlan()
    df.collect()
    return executed.toString()


def values(df, *columns):
    return [tuple(row) for row in df.select(*[F.col(c) for c in columns]).collect()]
