"""Changed files, arriving turns and the counts of a stream, against the batch operators."""

from __future__ import annotations

import os

from helpers import note
from pyspark.sql import functions as F

from noteflow.operators import conversations, records
from noteflow.plans import driver_queries
from noteflow.sources import generator
from noteflow.streaming import changes, ingest, turns


def put(folder, name, text, when):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(folder / name, (when, when))


def ages(spark, table, run=None):
    return {r.file_name: r.age for r in changes.as_of(spark, table, run).collect()}


def test_new_changed_and_gone_files(spark, tmp_path):
    folder, table = tmp_path / "raw", str(tmp_path / "table")
    for name, age in (("a.txt", 50), ("b +%.txt", 60), ("c.txt", 70)):
        put(folder, name, note(age=f"Age: {age}"), 1_700_000_000)
    put(folder, "not.csv", "Age: 1", 1_700_000_000)
    assert changes.ingest_changes(spark, str(folder), table) == {"run": 1, "n_new": 3, "n_changed": 0, "n_gone": 0}
    assert ages(spark, table) == {"a.txt": 50, "b +%.txt": 60, "c.txt": 70}

    # nothing new: nothing is written
    before = sorted(os.listdir(table))
    assert changes.ingest_changes(spark, str(folder), table)["n_new"] == 0 and sorted(os.listdir(table)) == before

    put(folder, "a.txt", note(age="Age: 51"), 1_700_000_100)  # same length, later time
    put(folder, "b +%.txt", note(age="Age: 6"), 1_700_000_000)  # same time, other length
    put(folder, "d.txt", b"\xff" + note(age="Age: 80").replace("\n", "\r\n").encode(), 1_700_000_200)
    (folder / "c.txt").unlink()
    assert changes.ingest_changes(spark, str(folder), table) == {"run": 2, "n_new": 1, "n_changed": 2, "n_gone": 1}
    assert ages(spark, table) == {"a.txt": 51, "b +%.txt": 6, "d.txt": 80}
    assert ages(spark, table, 1) == {"a.txt": 50, "b +%.txt": 60, "c.txt": 70}

    # one that was gone comes back as it was
    put(folder, "c.txt", note(age="Age: 70"), 1_700_000_000)
    assert changes.ingest_changes(spark, str(folder), table) == {"run": 3, "n_new": 1, "n_changed": 0, "n_gone": 0}
    assert ages(spark, table)["c.txt"] == 70
    # equal to a batch over the folder as it is
    batch = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.col("value").alias("raw_text"), F.lit("x").alias("file_name"))
    assert sorted(r.age for r in records.curate(batch).select("age").collect()) == sorted(ages(spark, table).values())


def test_only_changed_files_are_opened(spark, tmp_path):
    """The filter on the time reaches the scan, so an older file that cannot be read is no harm."""
    folder, table = tmp_path / "raw", str(tmp_path / "table")
    put(folder, "old.txt", note(), 1_600_000_000)
    changes.ingest_changes(spark, str(folder), table)
    put(folder, "new.txt", note(age="Age: 33"), 1_700_000_000)
    recent = changes._files(spark, str(folder), "*.txt", False).where(F.col("modificationTime") >= F.timestamp_seconds(F.lit(1_650_000_000)))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(modificationTime" in plan
    assert changes.ingest_changes(spark, str(folder), table) == {"run": 2, "n_new": 1, "n_changed": 0, "n_gone": 0}


TALK = [
    (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 3, "user", "d"), (1, 4, "user", "e"),
    (2, 0, "user", "x"), (None, 0, "user", "n"), (None, 1, "user", "m"), (3, None, "user", "first"), (3, 0, "user", "second"), (4, 5, None, None),
]


def test_arriving_turns_equal_the_whole_table(spark, tmp_path):
    path = str(tmp_path)
    whole = spark.createDataFrame(TALK, turns.MESSAGES)
    for lot in ("turn IS NULL OR turn < 1", "turn = 1 OR turn = 2", "turn > 2"):
        # each lot is taken in by a stream started anew
        whole.where(lot).repartition(2).write.mode("append").parquet(f"{path}/arriving")
        found = turns.run(spark, f"{path}/arriving", f"{path}/routed", f"{path}/checkpoint", files_per_trigger=None)
    places = {(r.conv_id, r.turn): (r.messages_before, r.user_messages_before) for r in conversations.turn_positions(whole).collect()}
    routes = {(r.conv_id, r.turn): r.route for r in conversations.routes(whole).collect()}
    rows = found.collect()
    assert len(rows) == len(TALK)
    for r in rows:
        assert (r.messages_before, r.user_messages_before) == places[r.conv_id, r.turn]
        assert r.route == routes.get((r.conv_id, r.turn))
    # a further run finds nothing new
    assert turns.run(spark, f"{path}/arriving", f"{path}/routed", f"{path}/checkpoint").count() == len(TALK)


def test_a_long_conversation_over_many_batches(spark, tmp_path):
    path = str(tmp_path)
    for lot in range(3):
        rows = [(7, t, "user" if t % 2 else "assistant", "t") for t in range(lot * 500, lot * 500 + 500)]
        spark.createDataFrame(rows, turns.MESSAGES).repartition(3).write.mode("append").parquet(f"{path}/arriving")
        found = turns.run(spark, f"{path}/arriving", f"{path}/routed", f"{path}/checkpoint")
    rows = {r.turn: r for r in found.collect()}
    assert all(rows[t].messages_before == t and rows[t].user_messages_before == t // 2 for t in range(1500))
    assert [t for t, r in rows.items() if r.route == "analyze"] == [1]


def test_counts_of_a_stream(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("table", "checkpoint", "metrics")]
    total = 0
    for lot, count in enumerate((5, 7)):
        generator.generate_notes(spark, count, seed=lot).select("raw_text", F.concat(F.lit(f"{lot}-"), "file_name").alias("file_name")).coalesce(2).write.mode("append").parquet(str(tmp_path / "raw"))
        arriving = spark.readStream.schema("raw_text string, file_name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "raw"))
        counted = ingest.run_counted_stream(arriving, *paths)
        total += count
        sums = counted.agg(F.sum("n_notes").alias("n"), F.sum(F.col("n_high") + F.col("n_medium") + F.col("n_low")).alias("labelled"), F.count("*").alias("rows"), F.countDistinct("batch").alias("batches")).first()
        assert (sums.n, sums.labelled) == (total, total) and sums.rows == sums.batches >= lot + 1
    # nothing new: no rows, and nothing told twice
    assert ingest.run_counted_stream(arriving, *paths).count() == sums.rows


def test_notes_of_a_micro_batch_are_dealt_out(spark, sf_dir):
    """A file of keys is read by one task; the notes made of it are many tasks' work."""
    driver_queries.stream_counts(spark, sf_dir).collect()
    [path] = [p for key, p in driver_queries._OWN_PATHS.items() if key[1:3] == (sf_dir, "counted-stream")]
    assert spark.read.parquet(f"{path}/table").select("_metadata.file_path").distinct().count() > 4
