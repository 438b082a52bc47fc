"""Seeded synthetic notes with planned faults, and the truth each was made from."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from .tables import patient_number

# Ranges and fault shares (in percent) of synthetic notes.
AGE_FROM, AGE_TO = 45, 89
STAY_FROM, STAY_TO = 1, 14
PRIOR_FROM, PRIOR_TO = 0, 5
MEDS_FROM, MEDS_TO = 2, 5
NO_AGE, NO_DIAGNOSIS, NO_MEDICATIONS = 10, 5, 8
COMPLEX, NON_COMPLIANT, ALONE = 30, 20, 25


def _draw(seed: int, use: str) -> Column:
    """A 63-bit number fixed by seed, use and id, so a retried task makes the same note."""
    return F.xxhash64(F.lit(seed), F.lit(use), F.col("id")).bitwiseAND(2**63 - 1)


def generate_notes(spark: SparkSession, count: int = 50, seed: int = 0) -> DataFrame:
    """``file_name``, ``raw_text`` and the truth columns of notes 1..count."""

    def between(use: str, low: int, high: int) -> Column:
        return (_draw(seed, use) % (high - low + 1) + low).cast("int")

    def choice(use: str, values) -> Column:
        return F.get(F.array(*map(F.lit, values)), (_draw(seed, use) % len(values)).cast("int"))

    def share(use: str, percent: int) -> Column:
        return _draw(seed, use) % 100 < percent

    shuffled = F.array_sort(
        F.array(
            *[F.struct(_draw(seed, f"order of {m}").alias("o"), F.lit(m).alias("m"))
              for m in rules.MEDICATIONS]
        )
    )
    drawn = spark.range(1, count + 1).select(
        F.concat(F.lit("PAT-"), patient_number(F.col("id"))).alias("patient_id"),
        F.concat(F.lit("patient_"), patient_number(F.col("id")), F.lit(".txt")).alias("file_name"),
        F.when(~share("no age", NO_AGE), between("age", AGE_FROM, AGE_TO)).alias("age"),
        choice("gender", ("Male", "Female")).alias("gender"),
        F.when(~share("no diagnosis", NO_DIAGNOSIS), choice("diagnosis", rules.DIAGNOSES))
        .alias("diagnosis"),
        between("stay", STAY_FROM, STAY_TO).alias("length_of_stay"),
        between("prior", PRIOR_FROM, PRIOR_TO).alias("prior_admissions"),
        F.when(
            ~share("no medications", NO_MEDICATIONS),
            F.slice(shuffled["m"], F.lit(1), between("medications", MEDS_FROM, MEDS_TO)),
        ).alias("medications"),
        choice("follow up", rules.FOLLOW_UP_SENTENCES).alias("follow_up"),
        choice("physician", rules.PHYSICIANS).alias("_physician"),
        share("complex", COMPLEX).alias("_complex"),
        share("non-compliant", NON_COMPLIANT).alias("_non_compliant"),
        share("alone", ALONE).alias("_alone"),
    )

    def line(label: str, value: Column | str) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.concat(F.lit(label), value.cast("string"))

    # The layout of a note, line by line.
    lines = [
        F.lit("Hospital note"),
        line("Patient ID: ", "patient_id"),
        line("Age: ", F.coalesce(F.col("age").cast("string"), F.lit("Unknown"))),
        line("Gender: ", "gender"),
        line("Seen by: ", "_physician"),
        F.lit(""),
        F.lit("Stay"),
        line("Primary Diagnosis: ", F.coalesce("diagnosis", F.lit("Not documented"))),
        F.concat(line("Length of Stay: ", "length_of_stay"), F.lit(" days")),
        line("Prior Admissions (past 12 months): ", "prior_admissions"),
        F.lit(""),
        line(
            "Medications at Discharge: ",
            F.coalesce(F.array_join("medications", ", "), F.lit("See pharmacy notes")),
        ),
        F.lit(""),
        F.lit("Course"),
        F.concat(
            line(
                "Patient was admitted for management of ",
                F.coalesce(F.lower("diagnosis"), F.lit("undocumented condition")),
            ),
            F.lit("."),
        ),
        F.when(F.col("_complex"), rules.COMPLEX_SENTENCE).otherwise(rules.IMPROVED_SENTENCE),
        F.when(F.col("_non_compliant"), rules.NON_COMPLIANCE_SENTENCE).otherwise(""),
        F.when(F.col("_alone"), rules.ALONE_SENTENCE).otherwise(rules.FAMILY_SENTENCE),
        F.lit(""),
        F.col("follow_up"),
        F.lit(""),
        line("Signed: ", "_physician"),
    ]
    truth = [c for c in drawn.columns if not c.startswith("_")]
    return drawn.select(
        F.concat_ws("\n", *lines).alias("raw_text"),
        *truth,
        (F.col("follow_up") != "").alias("has_follow_up"),
    )


def write_note_files(notes: DataFrame, folder: str) -> None:
    """Write each note as its own file, from the executors.

    ``folder`` must be a path every executor has mounted. A file appears under
    its name only when whole, so a retried task cannot leave half a note.
    """
    os.makedirs(folder, exist_ok=True)

    def write_rows(rows) -> None:
        for row in rows:
            target = os.path.join(folder, row.file_name)
            partial = os.path.join(folder, f".{row.file_name}.{os.getpid()}")
            with open(partial, "w", encoding="utf-8", newline="") as out:
                out.write(row.raw_text)
            os.replace(partial, target)

    notes.select("file_name", "raw_text").foreachPartition(write_rows)
