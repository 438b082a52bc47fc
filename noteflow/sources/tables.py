"""The driver's parquet tables, and a notes view derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

# Multipliers of the notes view's pseudo-random columns r(1)..r(14).
MULTIPLIERS = (
    2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233, 3624381081,
    1103515245, 1664525, 22695477, 134775813, 69069, 1597334677, 747796405,
)

# Medication lines of the notes view.
MEDICATION_LINES = (
    "Paracetamol 500mg, Ibuprofen 400mg",
    "Amoxicillin 250mg, Prednisolone 5mg, Folic acid 5mg",
    "Levothyroxine 50mcg, Tamsulosin 400mcg, Paracetamol 500mg, Folic acid 5mg",
    "Salmeterol inhaler, Prednisolone 5mg, Ibuprofen 400mg, Amoxicillin 250mg, Levothyroxine 50mcg",
)


#: Bytes of a note, about, and of the rows that one task makes or takes in.
NOTE_BYTES = 500
TASK_BYTES = 16 << 20
#: Tasks that share many small files.
TASKS_PER_CORE = 4
#: Bytes that a file of one note counts as: making it is most of its work.
FILE_BYTES = 16 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(i: int) -> str:
    """floor(((k + 1) * C_i mod 2^32) / 2^16), over ``m = (k + 1) mod 2^32``.

    C_i is split into two 16-bit halves so the product stays within a bigint
    for every key; the plain product overflows once keys pass 3 * 10^9.
    """
    low, high = MULTIPLIERS[i - 1] % 65536, MULTIPLIERS[i - 1] // 65536
    mixed = f"m * {low} + shiftleft(m * {high} & 65535, 16)"
    return f"shiftright(({mixed}) & {2**32 - 1}, 16)"


def _pick(i: int, values) -> str:
    listed = ", ".join(f"'{value}'" for value in values)
    return f"get(array({listed}), int({_r(i)} % {len(values)}))"


def patient_number(number: Column) -> Column:
    """Four digits at least, never cut: 7 -> 0007, 12345 -> 12345."""
    digits = number.cast("string")
    return F.when(number < 10000, F.lpad(digits, 4, "0")).otherwise(digits)


def _note_lines() -> list[str]:
    """SQL of each line of a note, over ``k``, ``m`` and ``number``."""
    low_row = "k % 211 = 11"
    return [
        "'Hospital note'",
        "if(k % 89 <> 3, concat('Patient ID: PAT-', number), null)",
        f"concat('Age: ', if({_r(2)} % 10 = 0 OR {low_row}, 'Unknown', string({_r(1)} % 45 + 45)))",
        f"concat('Gender: ', if({_r(3)} % 2 = 0, 'Male', 'Female'))",
        f"concat('Primary Diagnosis: ', if({_r(5)} % 20 = 0 OR {low_row}, 'Not documented', "
        f"{_pick(4, rules.DIAGNOSES)}))",
        f"if(k % 97 <> 5, concat('Length of Stay: ', {_r(6)} % 14 + 1, ' days'), null)",
        f"if(k % 101 <> 7, concat('Prior Admissions (past 12 months): ', {_r(7)} % 6), null)",
        f"concat('Medications at Discharge: ', if({_r(10)} % 12 = 0 OR {low_row}, "
        f"'See pharmacy notes', {_pick(8, MEDICATION_LINES)}))",
        f"if({_r(11)} % 5 = 0, '{rules.NON_COMPLIANCE_SENTENCE}', null)",
        f"if({_r(12)} % 4 = 0, '{rules.ALONE_SENTENCE}', '{rules.FAMILY_SENTENCE}')",
        _pick(13, rules.FOLLOW_UP_SENTENCES),
        f"concat('Signed: ', {_pick(9, rules.PHYSICIANS)})",
    ]


def notes_from_orders(orders: DataFrame) -> DataFrame:
    """``(raw_text, file_name)``, one note per order; row-local, reads the key only.

    Every note is a function of its order key alone, so it is the same on each
    retry and in each engine. See FIXTURES.md section 2 for the formulas.
    """
    keyed = orders.select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_orderkey") + 1).bitwiseAND(2**32 - 1).alias("m"),
        patient_number(F.col("o_orderkey")).alias("number"),
    )
    return keyed.selectExpr(
        f"concat_ws(chr(10), {', '.join(_note_lines())}) AS raw_text",
        "concat('patient_', number, '.txt') AS file_name",
    )


def spread(df: DataFrame, *keys: str, bytes_a_row: int) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its work asks for.

    A number given by name is one that adaptive execution leaves alone: rows of few bytes that much
    is made of would else meet in one task. Tasks make ``TASK_BYTES`` each, by the optimizer's
    estimate of the rows, and are no fewer than the cores.
    """
    return df.repartition(tasks_for(df, bytes_a_row), *keys)


def tasks_for(df: DataFrame, bytes_a_row: int) -> int:
    """The tasks that :func:`spread` deals ``df`` out to; for a stream, asked of a table of the same rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    rows = int(plan.stats().sizeInBytes()) // (int(plan.schema().defaultSize()) + 8)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, rows * bytes_a_row // TASK_BYTES)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per order. The keys, a few bytes each, are dealt out before notes are made of them."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return notes_from_orders(spread(keys, "o_orderkey", bytes_a_row=NOTE_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of the documents table, on all cores where the scan would use few.

    A table of few large row groups is read by as few tasks; texts of a large one stay where they are.
    """
    found = table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * TASK_BYTES:
        # by a hash of the row: a source or an id that many rows share is dealt out as well
        return found.repartition(cores, F.xxhash64("doc_id", "text"))
    return found
