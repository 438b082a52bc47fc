"""Note text to typed fields, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rules import FieldSpec

BLANKS = " \t\r\n"


def capture(text: Column, spec: FieldSpec, strict: bool = False) -> Column:
    """First captured group of ``spec`` in ``text``, trimmed; ``''`` when nothing matches."""
    found = F.regexp_extract(text, spec.pattern(strict), 1)
    return F.btrim(found, F.lit(BLANKS)) if spec.dtype == "string" else found


def typed(captured: Column, spec: FieldSpec) -> Column:
    """Captured text to the field's type; NULL when absent, marked absent or not castable."""
    given = captured != ""
    if spec.null_if is not None:
        given = given & ~F.lower(captured).contains(spec.null_if)
    return F.when(given, captured if spec.dtype == "string" else captured.try_cast(spec.dtype))


def follow_up(lowered: Column) -> Column:
    return lowered.contains(rules.FOLLOW_UP_PHRASE) & ~lowered.contains(rules.NO_FOLLOW_UP_PHRASE)


def lives_alone(lowered: Column) -> Column:
    return lowered.contains(rules.LIVES_ALONE_PHRASE)


def non_compliant(lowered: Column) -> Column:
    return lowered.contains(rules.NON_COMPLIANCE_PHRASE)


def capture_name(spec: FieldSpec) -> str:
    return f"_found_{spec.name}"


def typed_columns(specs: Sequence[FieldSpec]) -> dict[str, Column]:
    """Typed columns over the captures named by :func:`capture_name`."""
    return {s.name: typed(F.col(capture_name(s)), s) for s in specs}
