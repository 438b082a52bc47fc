"""The batch job, the stream, and the plans both run."""

from __future__ import annotations

import json

import pytest
from helpers import note, notes, plan
from pyspark.sql import functions as F

import oracles
from noteflow.operators import records, reports
from noteflow.plans import batch_job, driver_queries
from noteflow.schemas import SERVING
from noteflow.sources import generator, readers, sinks, tables
from noteflow.streaming.ingest import run_curated_stream
from tools.check_oracles import connect


def folder_of_notes(spark, path, count=30):
    made = generator.generate_notes(spark, count, seed=3)
    generator.write_note_files(made, str(path))
    return str(path)


def test_batch_job(spark, tmp_path):
    raw = folder_of_notes(spark, tmp_path / "raw")
    (tmp_path / "raw" / "low.txt").write_text("Patient ID: PAT-9999\n")
    knowledge = tmp_path / "knowledge"
    knowledge.mkdir()
    (knowledge / "guide.txt").write_text("a" * 400 + "\n\n" + "b" * 400)
    out = str(tmp_path / "out")

    counts = batch_job.run_batch(spark, raw, out, str(knowledge))
    curated = readers.read_curated(spark, f"{out}/curated")
    labels = {r.confidence_label: r.n_records for r in reports.confidence_counts(curated).collect()}
    assert counts["n_notes"] == curated.count() == 31
    assert (counts["n_high"], counts["n_medium"], counts["n_low"]) == tuple(
        labels.get(name, 0) for name in ("HIGH", "MEDIUM", "LOW")
    )
    assert counts["n_serving"] == readers.read_serving(spark, f"{out}/serving").count() == 31 - labels["LOW"]
    assert counts["n_chunks"] == readers.read_vectors(spark, f"{out}/vectors").count() == 2

    assert not batch_job.ensure_batch(spark, raw, out, knowledge_folder=str(knowledge))
    assert batch_job.ensure_batch(spark, raw, str(tmp_path / "other"))


def test_notes_are_made_only_where_none_are(spark, tmp_path):
    raw = str(tmp_path / "raw")
    assert batch_job.ensure_notes(spark, raw)
    assert readers.read_notes(spark, raw).count() == 50
    (tmp_path / "raw" / "patient_0001.txt").write_text("kept")
    assert not batch_job.ensure_notes(spark, raw)
    assert (tmp_path / "raw" / "patient_0001.txt").read_text() == "kept"


def test_batch_job_reads_the_notes_once(spark, tmp_path):
    """Counted by an accumulator: every note passes the job a single time."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    source = notes(spark, *[note()] * 8)
    batch_job.run_batch_on(source.mapInPandas(count, source.schema), str(tmp_path / "out"))
    assert seen.value == 8


def test_stream_takes_each_file_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(3):
        (raw / f"n{i}.txt").write_text(note(id=f"Patient ID: PAT-000{i}"))
    (raw / "skip.md").write_text("no")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def run():
        return run_curated_stream(readers.stream_notes(spark, str(raw), 2), table, checkpoint)

    assert run().count() == 3
    assert run().count() == 3
    (raw / "n3.txt").write_text(note(id="Patient ID: PAT-0003"))
    streamed = run()
    assert streamed.count() == 4
    batch = records.curate(readers.read_notes(spark, str(raw)))
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_scoring_a_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text(note())
    scored = records.with_points(records.curate(readers.stream_notes(spark, str(tmp_path))))
    assert scored.isStreaming


def test_questions_reach_the_curated_scan(spark, tmp_path):
    path = str(tmp_path / "curated")
    sinks.write_curated(records.curate(notes(spark, note(), note())), path)
    curated = readers.read_curated(spark, path)
    served = plan(records.serving_set(curated))
    assert "PushedFilters: [IsNotNull(is_scoreable), EqualTo(is_scoreable,true)]" in served
    assert "raw_text" not in served
    one = plan(reports.explain_patient(curated, "PAT-0001"))
    assert "EqualTo(patient_id,PAT-0001)" in one
    assert "BroadcastHashJoin" in one
    summary = plan(reports.risk_summary(records.with_points(curated)))
    assert "medications_raw" not in summary and "raw_text" not in summary
    assert summary.count("Exchange (") == 1


def test_each_regex_appears_once(spark):
    """Filters and scores over extracted columns must not repeat the extraction."""
    curated = records.curate(notes(spark, note()))
    scored = records.with_points(curated)
    for df in (
        reports.quality_issues(curated),
        reports.over_age_high_risk(scored),
        reports.highest_risk(scored),
        records.serving_set(curated),
    ):
        assert plan(df, "simple").count("regexp_extract(") <= 7


def test_top_k_is_not_a_full_sort(spark):
    scored = records.with_points(records.curate(notes(spark, note())))
    assert "TakeOrderedAndProject" in plan(reports.highest_risk(scored))
    assert "TakeOrderedAndProject" in plan(reports.first_records(records.serving_set(scored)))


def test_notes_view(spark, sf_dir):
    view = tables.notes(spark, sf_dir)
    totals = view.agg(F.count("*"), F.sum(F.length("raw_text")), F.min(F.md5("raw_text"))).first()
    con = connect(sf_dir)
    same = con.execute(f"WITH {oracles._NOTES} SELECT count(*), sum(length(raw_text)), min(md5(raw_text)) FROM notes")
    assert tuple(totals) == same.fetchone() and totals[0] == 1500
    crosstab = {(r.risk_tier, r.signal_tier): r.n_patients
                for r in reports.risk_crosstab(records.curate(view)).collect()}
    assert crosstab == {("HIGH", "HIGH"): 795, ("MEDIUM", "HIGH"): 16, ("MEDIUM", "MEDIUM"): 588,
                        ("LOW", "MEDIUM"): 71, ("LOW", "LOW"): 30}


@pytest.mark.parametrize("key", [0, 2**31, 2**33 + 5, 10**12])
def test_notes_view_holds_for_large_keys(spark, key):
    row = tables.notes_from_orders(spark.createDataFrame([(key,)], "o_orderkey bigint")).first()
    low, high = (key + 1) * tables.MULTIPLIERS[2] % 2**32 // 2**16, row.raw_text
    assert ("Gender: Male" if low % 2 == 0 else "Gender: Female") in high
    assert row.file_name == f"patient_{key:04d}.txt"


def test_record_counts(spark):
    df = records.curate(notes(spark, note(), note(), note(drop=("id",)), note(drop=("age", "dx", "meds"))))
    assert reports.record_counts(df).first().asDict() == {
        "n_notes": 4, "n_with_id": 3, "n_scoreable": 3, "n_repeated_ids": 2
    }


def test_serving_lines_are_valid_json(spark, tmp_path):
    sinks.write_serving(records.curate(notes(spark, note(drop=("age",)))), str(tmp_path / "s"))
    (line,) = [x for f in (tmp_path / "s").glob("*.json") for x in f.read_text().splitlines()]
    assert list(json.loads(line)) == SERVING.names


def test_notes_and_documents_are_spread_over_the_cores(spark):
    """Keys are small and notes are not: adaptive execution must not merge them into one task."""
    sf_dir = "/root/testdata/sf0.01"
    for df in (driver_queries.extract_fields(spark, sf_dir), tables.documents(spark, sf_dir)):
        counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
        total = sum(r["count"] for r in counts)
        assert len(counts) == spark.sparkContext.defaultParallelism
        assert max(r["count"] for r in counts) < 2 * total / len(counts)
