"""Routing, history and prompts, against a plain reading of each conversation."""

from __future__ import annotations

import json
import random
import re

import pytest
from helpers import note, notes, plan

from noteflow.operators import conversations, records, reports
from noteflow.plans import driver_queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def talk(spark, *rows):
    return spark.createDataFrame([(*r, f"text {i}") if len(r) == 3 else r for i, r in enumerate(rows)], SCHEMA)


def test_routes(spark):
    messages = talk(
        spark,
        (1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "user"),
        (2, 0, "assistant"), (2, 5, "user"),
        (3, 0, "system"),
    )
    rows = {(r.conv_id, r.turn): (r.route, r.path) for r in conversations.routes(messages).collect()}
    first = ("analyze", ["load_data", "retrieve", "analyze"])
    assert rows == {(1, 1): first, (1, 3): ("followup", ["retrieve", "followup"]), (2, 5): first}


@pytest.mark.parametrize("segment", [1, 2, 3, 1024])
def test_positions_and_history(spark, segment):
    rng = random.Random(5)
    rows = []
    for conv in range(6):
        turns = sorted(rng.sample(range(40), rng.randint(1, 25)))
        rows += [(conv, t, rng.choice(["user", "assistant", "system"])) for t in turns]
    rows += [(0, t, "user") for _, t, _ in rows[:2]]  # repeated turns
    messages = talk(spark, *rows).cache()

    for r in conversations.turn_positions(messages, segment).collect():
        before = [m for m in rows if m[0] == r.conv_id and m[1] < r.turn]
        after = [m[1] for m in rows if m[0] == r.conv_id and m[1] > r.turn and m[2] == "user"]
        assert r.messages_before == len(before)
        assert r.user_messages_before == sum(m[2] == "user" for m in before)
        assert r.next_user_turn == (min(after) if after else None)

    history = conversations.history(messages, segment).collect()
    assert len(history) == len(rows)
    for conv, turn, role in rows:
        if role != "user":
            continue
        seen = [h for h in history if h.conv_id == conv and h.visible_from is not None and h.visible_from <= turn]
        expected = [t for c, t, _ in rows if c == conv and t < turn]
        assert [h.turn for h in sorted(seen, key=lambda h: (h.position, h.text))] == sorted(expected)


def test_history_of_chosen_turns(spark):
    messages = talk(spark, (1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (2, 0, "user"))
    chosen = spark.createDataFrame([(1, 2), (2, 0)], "conv_id bigint, turn bigint")
    rows = conversations.history_of(messages, chosen).collect()
    assert sorted((r.asked_turn, r.turn) for r in rows) == [(2, 0), (2, 1)]


def test_no_task_orders_a_whole_conversation(spark):
    """Messages are windowed by segment; by conversation, only segment totals are."""
    text = plan(conversations.turn_positions(talk(spark, (1, 0, "user"))))
    ordered = [line for line in text.splitlines() if line.startswith("Arguments: [") and "windowspec" in line]
    by_conversation = [line for line in ordered if "windowspecdefinition(conv_id" in line and "segment#" in line]
    assert by_conversation
    assert not [line for line in ordered if "windowspecdefinition(conv_id" in line and "turn#" in line
                and "segment#" not in line]


def test_joins_spread_a_conversation(spark, set_conf):
    """Messages are shuffled by conversation and turn, never by conversation alone."""
    set_conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    messages = talk(spark, (1, 0, "user"))
    for df in (conversations.routes(messages), conversations.history(messages)):
        # keys are compared so that NULL equals NULL, which wraps each of them
        joins = [set(re.findall(r"(\w+)#\d+", line)) for line in re.findall(r"SortMergeJoin \[(.*?)\], \[", plan(df, "simple"))]
        assert joins and all(keys in ({"conv_id", "turn"}, {"conv_id", "segment"}) for keys in joins)
        dealt = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan(df, "simple"))
        assert any(set(re.findall(r"(\w+)#\d+", keys)) == {"conv_id", "turn"} for keys in dealt)


def test_sparse_turns_share_segments(spark):
    """Segments hold about as many turns as asked for, whatever the turns' values are."""
    messages = spark.range(5000).selectExpr(
        "1L conv_id", "id * 1000000007 turn", "if(id % 2 = 0, 'user', 'assistant') role", "'x' text"
    )
    text = plan(conversations.turn_positions(messages, segment=500))
    ranges = re.findall(r"/segments-\w+", text)
    written = spark.read.parquet(next(p for p in conversations.turn_positions(messages, 500).inputFiles())[: -len("x")].rsplit("/", 1)[0])
    assert ranges and 5 <= written.select("segment").distinct().count() <= 10
    rows = conversations.history(messages, segment=500).orderBy("turn").collect()
    assert [r.position for r in rows] == list(range(1, 5001))


def test_null_keys_are_kept(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "user", "b"), (1, None, "user", "c"), (1, 5, "user", "d"), (2, None, "assistant", "e")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    routed = {r.text: r.route for r in conversations.routes(messages).collect()}
    assert routed == {"a": "analyze", "b": "followup", "c": "analyze", "d": "followup"}
    placed = {r.text: (r.position, r.visible_from) for r in conversations.history(messages).collect()}
    assert placed == {"a": (1, 2), "b": (2, None), "c": (1, 5), "d": (2, None), "e": (1, None)}
    asked = messages.filter("role = 'user'").select("conv_id", "turn")
    listed = sorted((r.text, r.asked_turn) for r in conversations.history_of(messages, asked).collect())
    assert listed == [("a", 2), ("c", 5)]


def test_one_conversation_holds_most_messages(spark):
    messages = spark.range(60000).selectExpr(
        "if(id % 3 = 0, id, -1) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "'x' text"
    )
    rows = conversations.history(messages).filter("conv_id = -1").orderBy("turn").collect()
    assert [r.position for r in rows] == list(range(1, 40001))
    later = [r.turn for r in rows if r.role == "user"] + [None]
    upcoming = 0
    for r in rows:
        while later[upcoming] is not None and later[upcoming] <= r.turn:
            upcoming += 1
        assert r.visible_from == later[upcoming]
    routes = conversations.routes(messages).filter("conv_id = -1 AND route = 'analyze'").collect()
    assert [r.turn for r in routes] == [min(r.turn for r in rows if r.role == "user")]


def served(spark, count):
    texts = [note(id=f"Patient ID: PAT-{i:04d}") for i in range(count, 0, -1)]
    return records.serving_set(records.curate(notes(spark, *texts, note(drop=("id",)))))


def test_first_records_in_order(spark):
    shown = reports.first_records(served(spark, 30)).collect()
    assert [r.patient_id for r in shown] == [f"PAT-{i:04d}" for i in range(1, 21)]
    few = reports.first_records(served(spark, 3)).collect()
    assert [r.patient_id for r in few] == ["PAT-0001", "PAT-0002", "PAT-0003", None]


def test_prompts(spark):
    turns = spark.createDataFrame(
        [(1, 1, "analyze", "Who is at risk?", "Sepsis: 20%"), (1, 3, "followup", "And why?", "")],
        "conv_id bigint, turn bigint, route string, text string, context string",
    )
    rows = {r.route: r.prompt for r in conversations.prompts(turns, served(spark, 30)).collect()}
    for prompt in rows.values():
        assert "31 in all, first 20 shown" in prompt
        listed = json.loads(prompt.splitlines()[1])
        assert [r["patient_id"] for r in listed] == [f"PAT-{i:04d}" for i in range(1, 21)]
        assert listed[0]["medications_raw"] == "Aspirin 81mg, Warfarin 5mg"
    assert "Guideline passages:\nSepsis: 20%\n\nQuestion:\nWho is at risk?\n" in rows["analyze"]
    assert "Follow-up question:\nAnd why?\n" in rows["followup"]


def test_registered_prompts(spark, sf_dir):
    """The whole-table query, put together anew from its parts."""
    contexts = {r.query_id: r.context for r in driver_queries.retrieve_context(spark, sf_dir).collect()}
    serving = driver_queries.serving_set(spark, sf_dir)
    (shown,) = conversations.records_json(serving).first()
    listed = [r.asDict() for r in reports.first_records(serving).collect()]
    assert json.loads(shown) == listed
    total = serving.count()
    messages = driver_queries.messages(spark, sf_dir).collect()
    first = {}
    for m in messages:
        if m.role == "user":
            first[m.conv_id] = min(m.turn, first.get(m.conv_id, m.turn))
    found = {(r.conv_id, r.turn): r for r in driver_queries.prompt_table(spark, sf_dir).collect()}
    asked = [m for m in messages if m.role == "user"]
    assert len(found) == len(asked)
    for m in asked:
        row = found[m.conv_id, m.turn]
        assert row.route == ("analyze" if first[m.conv_id] == m.turn else "followup")
        body = row.prompt.split(":\n", 1)
        assert f"{total} in all" in body[0]
        rest = body[1].removeprefix(shown)
        assert f"passages:\n{contexts[f'{m.conv_id}:{m.turn}']}\n\n" in rest
        assert f"uestion:\n{m.text}\n\nAnswer" in rest


def test_prompt_keeps_null_fields(spark):
    few = conversations.records_json(served(spark, 1)).first().records
    assert [r["patient_id"] for r in json.loads(few)] == ["PAT-0001", None]
