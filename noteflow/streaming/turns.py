"""Routing of conversation turns as they arrive.

Each conversation's state is two numbers, its messages and its user messages so far, kept by the stream under the
conversation's id. A turn is routed by the state it meets: ``analyze`` for the first user turn of its conversation,
``followup`` for later ones, as :func:`conversations.routes` does for a whole table, and it gets the numbers of messages and
of user messages before it, as :func:`conversations.turn_positions`.

Turns of one conversation that arrive in one micro-batch are taken in order of their numbers, those of equal number
together; a turn that arrives after a later one is routed by what has come before it, since the other answer is out.
State and offsets live in the checkpoint, so a stream started anew goes on where it stopped.
A conversation's turns of one micro-batch are held by one task, so ``maxFilesPerTrigger`` bounds them. A NULL
``conv_id`` is a conversation like any other; a NULL ``turn`` comes before all others of its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGES = "conv_id long, turn long, role string, text string"
ROUTED = "conv_id long, turn long, route string, messages_before long, user_messages_before long"
_STATE = "n long, n_user long"


def routed(arriving: DataFrame) -> DataFrame:
    """A stream of ``conv_id, turn, role`` as a stream of :data:`ROUTED`: every message once, ``route`` of user turns only."""
    keyed = arriving.select("conv_id", "turn", "role").groupBy("conv_id")
    return keyed.applyInPandasWithState(_route, ROUTED, _STATE, "append", GroupStateTimeout.NoTimeout)


def _route(key: tuple, lots: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, n_user = state.get if state.exists else (0, 0)
    turns = pd.concat(list(lots)).sort_values("turn", kind="stable", na_position="first")
    # turns of one number see the same messages before them
    number = turns["turn"].astype("Int64").fillna(-(1 << 62))
    user = (turns["role"] == "user").astype("int64")
    first = number.groupby(number).cumcount()
    own_user = user.groupby(number).cumsum() - user
    before = n + pd.Series(range(len(turns)), index=turns.index, dtype="int64") - first
    before_user = n_user + user.cumsum() - user - own_user
    route = pd.Series(["followup"] * len(turns), index=turns.index, dtype="object")
    route[before_user == 0] = "analyze"
    route[user == 0] = None
    state.update((n + len(turns), n_user + int(user.sum())))
    conv = pd.Series([key[0]] * len(turns), index=turns.index, dtype="Int64")
    yield pd.DataFrame({
        "conv_id": conv, "turn": turns["turn"].astype("Int64"), "route": route,
        "messages_before": before, "user_messages_before": before_user,
    })


def start(spark: SparkSession, arriving: str, table: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Route every message file of ``arriving`` not seen before, append to ``table``, then stop."""
    reader = spark.readStream.schema(MESSAGES)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (
        routed(reader.parquet(arriving)).writeStream.format("parquet")
        .outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run(spark: SparkSession, arriving: str, table: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream until all present messages are routed; return the table."""
    start(spark, arriving, table, checkpoint, files_per_trigger).awaitTermination()
    return spark.read.schema(ROUTED).parquet(table)
