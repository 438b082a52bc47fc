"""Declared schema of each layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "array<double>": ArrayType(DoubleType()),
}


def _schema(columns: str) -> StructType:
    """``"a int, b string"`` as a schema; unlike a DDL string it needs no session."""
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, _TYPES[dtype]) for name, dtype in pairs])


RAW = _schema("raw_text string, file_name string")

EXTRACTED = _schema(
    "patient_id string, age int, gender string, diagnosis string, "
    "length_of_stay int, prior_admissions int, has_follow_up boolean, "
    "lives_alone boolean, non_compliant boolean, medications_raw string"
)

QUALITY = _schema(
    "completeness_score double, missing_fields string, confidence_label string, "
    "is_scoreable boolean, quality_warning string"
)

CURATED = StructType(RAW.fields + EXTRACTED.fields + QUALITY.fields)

SERVING = StructType(
    EXTRACTED.fields
    + [QUALITY["completeness_score"], QUALITY["confidence_label"], QUALITY["quality_warning"]]
)

DOCUMENT = _schema("doc_id string, text string")
CHUNK = _schema("vec_id string, doc_id string, chunk_ix int, chunk string")
VECTOR = _schema("vec_id string, chunk string, embedding array<double>")
CONVERSATION = _schema("conv_id bigint, turn bigint, role string, text string")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select exactly the columns of ``schema``; fail on a missing column or type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if have.get(field.name) != field.dataType:
            raise TypeError(
                f"column {field.name}: expected {field.dataType.simpleString()}, "
                f"found {have[field.name].simpleString() if field.name in have else 'nothing'}"
            )
    return df.select(*schema.names)
