"""Routing, history and prompts of conversation turns.

Input is ``conv_id, turn, role, text``. One conversation may hold a large share
of all messages, so none of this collects or orders a whole conversation in one
task: counts are folded per turn, turns are cut into segments of about equal
numbers whatever their values are, and only one total per segment is ordered by
conversation.

A NULL ``conv_id`` is a conversation like any other; a NULL ``turn`` comes before
all others of its conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.work import written
from . import reports

SEGMENT = 1024
#: Ranges that turns are cut into at most; beyond it segments grow.
MOST_SEGMENTS = 10_000
#: Parts of a conversation when its messages are listed for chosen turns.
SALTS = 16

# Steps of a first turn and of a later one.
FIRST_PATH = ("load_data", "retrieve", "analyze")
LATER_PATH = ("retrieve", "followup")


def user_turns(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role") == "user")


def routes(messages: DataFrame) -> DataFrame:
    """User turns with ``route`` and ``path``: ``analyze`` when no user turn came
    before in the conversation, else ``followup``.

    The first user turn is a minimum per conversation. It is joined back on
    conversation and turn together, so no join key is hot.
    """
    turns = user_turns(messages)
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("first.turn").alias("_turn"), F.lit(True).alias("_first"))

    def array(steps) -> Column:
        return F.array(*map(F.lit, steps))

    is_first = F.col("_first").isNotNull()
    same = turns["conv_id"].eqNullSafe(first["_conv"]) & turns["turn"].eqNullSafe(first["_turn"])
    return turns.join(first, same, "left").select(
        *messages.columns,
        F.when(is_first, "analyze").otherwise("followup").alias("route"),
        F.when(is_first, array(FIRST_PATH)).otherwise(array(LATER_PATH)).alias("path"),
    )


def turn_positions(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per turn: messages and user messages before it, and the next user turn.

    A running count in two levels: inside a segment of about ``segment`` turns,
    and over the totals of the segments before it. Segments are ranges of
    (conversation, turn), written once so that both levels see the same ones.
    """
    is_user = F.count_if(F.col("role") == "user")
    per_turn = written(messages.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), is_user.alias("n_user")), "turns")
    ranges = min(max(1, -(-per_turn.count() // segment)), MOST_SEGMENTS)
    ranged = per_turn.repartitionByRange(ranges, "conv_id", "turn").withColumn("segment", F.spark_partition_id())
    per_turn = written(ranged, "segments")
    user_turn = F.when(F.col("n_user") > 0, F.col("turn"))

    per_segment = per_turn.groupBy("conv_id", "segment").agg(
        F.sum("n").alias("n"), F.sum("n_user").alias("n_user"), F.min(user_turn).alias("user_turn")
    )

    def before(keys, order) -> Window:
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def count_before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    # "Next" is the smallest value before a row in descending order; a frame that
    # ends at the last row would be summed up anew for every row.
    earlier, later = before(["conv_id"], "segment"), before(["conv_id"], F.desc("segment"))
    offsets = per_segment.select(
        "conv_id",
        "segment",
        count_before("n", earlier).alias("n_offset"),
        count_before("n_user", earlier).alias("n_user_offset"),
        F.min("user_turn").over(later).alias("user_turn_after"),
    )
    keys = ["conv_id", "segment"]
    above, below = before(keys, "turn"), before(keys, F.desc("turn"))
    offsets = offsets.withColumnsRenamed({"conv_id": "_conv", "segment": "_segment"})
    same = per_turn["conv_id"].eqNullSafe(offsets["_conv"]) & (per_turn["segment"] == offsets["_segment"])
    return per_turn.join(offsets, same).select(
        "conv_id",
        "turn",
        (F.col("n_offset") + count_before("n", above)).alias("messages_before"),
        (F.col("n_user_offset") + count_before("n_user", above)).alias("user_messages_before"),
        F.coalesce(F.min(user_turn).over(below), F.col("user_turn_after")).alias("next_user_turn"),
    )


def history(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Each message once, with its place and the first user turn that sees it.

    The history of user turn ``t`` is every message of its conversation with
    ``visible_from <= t``, ordered by ``position``; a message nobody asked after
    has no ``visible_from``. Writing out one list per turn instead would grow
    with the square of the conversation's length. :func:`history_of` lists the
    messages for chosen turns.
    """
    places = turn_positions(messages, segment).withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    same = messages["conv_id"].eqNullSafe(places["_conv"]) & messages["turn"].eqNullSafe(places["_turn"])
    return messages.join(places, same).select(
        *messages.columns,
        (F.col("messages_before") + 1).alias("position"),
        F.col("next_user_turn").alias("visible_from"),
    )


def history_of(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """The messages before each of the chosen ``turns(conv_id, turn)``, one per row.

    As many rows as the chosen turns have messages before them, so choose a few of a
    long conversation. Its messages are dealt to ``SALTS`` parts, each of which
    meets every chosen turn.
    """
    chosen = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("asked_turn"))
    chosen = chosen.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64("turn", "text"), F.lit(SALTS)).cast("int")
    before = (F.col("turn") < F.col("asked_turn")) | (F.col("turn").isNull() & F.col("asked_turn").isNotNull())
    same = messages["conv_id"].eqNullSafe(chosen["_conv"]) & (part == chosen["_part"])
    return messages.join(chosen, same & before).drop("_conv", "_part")


# ---- prompts ---------------------------------------------------------------

def records_json(serving: DataFrame, n: int = rules.RECORDS_IN_PROMPT) -> DataFrame:
    """One row: the first ``n`` records by patient id as one JSON array."""
    shown = reports.first_records(serving, n)
    row = F.struct(F.col("patient_id").isNull().alias("_last"), *serving.columns)
    ordered = F.array_sort(F.collect_list(row))
    rows = F.transform(ordered, lambda r: F.struct(*[r[c].alias(c) for c in serving.columns]))
    return shown.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("records"))


def prompts(turns: DataFrame, serving: DataFrame) -> DataFrame:
    """Add ``prompt`` to routed turns that carry their ``context``.

    The shown records and the full count are single values, computed once each
    and used by every turn; ``serving`` is read for both, so write it first. Both
    kinds of turn state the true count. A later turn's prompt follows its history:
    the messages of :func:`history` in the first ``messages_before`` places.
    """
    records = records_json(serving).scalar()
    total = serving.agg(F.count("*").alias("n")).scalar()
    is_first = F.col("route") == "analyze"

    def by_route(first: str, later: str) -> Column:
        return F.when(is_first, first).otherwise(later)

    prompt = F.concat(
        by_route("Patient records, ", "Patient records for reference, "),
        total.cast("string"),
        F.lit(f" in all, first {rules.RECORDS_IN_PROMPT} shown:\n"),
        records,
        by_route("\n\nGuideline passages:\n", "\n\nFurther guideline passages:\n"),
        F.col("context"),
        by_route("\n\nQuestion:\n", "\n\nFollow-up question:\n"),
        F.col("text"),
        by_route(
            "\n\nAnswer for the patients at hand, give the points behind each tier and say where a record has gaps.",
            "\n\nAnswer with the earlier turns in mind; give the ids and figures it rests on.",
        ),
    )
    return turns.withColumn("prompt", prompt)
