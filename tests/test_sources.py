"""Note folders, sinks, and the note generator."""

from __future__ import annotations

import json
import os
import pathlib

import pytest
from helpers import note, notes
from pyspark.sql import functions as F

from noteflow.operators import records
from noteflow.plans import driver_queries
from noteflow.schemas import CURATED, SERVING, conform
from noteflow.sources import generator, readers, sinks, tables


def put(folder, **files):
    for name, content in files.items():
        data = content if isinstance(content, bytes) else content.encode()
        (folder / name).write_bytes(data)


def test_reads_only_txt_and_keeps_names(spark, tmp_path):
    put(tmp_path, **{"a b.txt": note(), "c+d.txt": note(), "notes.md": "no", "é.txt": note()})
    df = readers.read_notes(spark, str(tmp_path))
    assert sorted(r.file_name for r in df.collect()) == ["a b.txt", "c+d.txt", "é.txt"]


def test_one_file_is_one_row_with_plain_line_ends(spark, tmp_path):
    put(tmp_path, **{"lf.txt": "a\nb\nc", "crlf.txt": "a\r\nb\r\nc", "cr.txt": "a\rb\rc"})
    texts = [r.raw_text for r in readers.read_notes(spark, str(tmp_path)).collect()]
    assert texts == ["a\nb\nc"] * 3


def test_bad_bytes_are_replaced(spark, tmp_path):
    put(tmp_path, **{"x.txt": b"Age: 57 \xff."})
    assert readers.read_notes(spark, str(tmp_path)).first().raw_text == "Age: 57 �."


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_notes(spark, str(tmp_path / "none"))
    put(tmp_path, **{"notes.md": "no"})
    with pytest.raises(ValueError):
        readers.read_notes(spark, str(tmp_path))


def test_knowledge_documents(spark, tmp_path):
    put(tmp_path, **{"guide.txt": "HIGH RISK"})
    assert [tuple(r) for r in readers.read_knowledge(spark, str(tmp_path)).collect()] == [
        ("guide.txt", "HIGH RISK")
    ]


def test_curated_and_serving_round_trip(spark, tmp_path):
    df = records.curate(notes(spark, note(), note(drop=("age",)), note(drop=("age", "dx", "meds"))))
    sinks.write_curated(df, str(tmp_path / "curated"))
    back = readers.read_curated(spark, str(tmp_path / "curated"))
    assert sorted(back.collect()) == sorted(df.collect())

    sinks.write_serving(back, str(tmp_path / "serving"))
    served = readers.read_serving(spark, str(tmp_path / "serving"))
    assert served.schema == SERVING
    assert sorted(served.collect(), key=str) == sorted(records.serving_set(df).collect(), key=str)

    # NULL is written out, as valid JSON.
    lines = [line for f in (tmp_path / "serving").glob("*.json") for line in f.read_text().splitlines()]
    parsed = [json.loads(line) for line in lines]
    assert all(set(p) == set(SERVING.names) for p in parsed)
    assert any(p["age"] is None for p in parsed)


def test_overwrite_replaces_everything(spark, tmp_path):
    target = str(tmp_path / "curated")
    sinks.write_curated(records.curate(notes(spark, note(), note())), target)
    sinks.write_curated(records.curate(notes(spark, note())), target)
    assert readers.read_curated(spark, target).count() == 1


def test_serving_from_a_json_array(spark, tmp_path):
    row = {name: None for name in SERVING.names} | {"patient_id": "PAT-0001", "age": 57}
    (tmp_path / "array.json").write_text(json.dumps([row, row], indent=2))
    df = readers.read_serving(spark, str(tmp_path / "array.json"), json_array=True)
    assert [(r.patient_id, r.age) for r in df.collect()] == [("PAT-0001", 57)] * 2


def test_absent_inputs(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere")
    assert readers.read_serving(spark, nowhere, missing_ok=True).count() == 0
    for read in (readers.read_serving, readers.read_curated, readers.read_vectors):
        with pytest.raises(FileNotFoundError):
            read(spark, nowhere)


def test_materialise_once(spark, tmp_path):
    target = tmp_path / "out"
    runs = []

    def build():
        runs.append(1)
        spark.range(3).write.mode("overwrite").parquet(str(target))

    assert sinks.materialise_once(spark, str(target), build)
    assert not sinks.materialise_once(spark, str(target), build)
    (target / "_SUCCESS").unlink()  # a job that was lost before it ended
    assert sinks.materialise_once(spark, str(target), build)
    assert len(runs) == 2


def test_conform_names_the_wrong_column(spark):
    with pytest.raises(TypeError, match="file_name"):
        conform(spark.createDataFrame([("x",)], "raw_text string"), CURATED)


# ---- generator -------------------------------------------------------------

@pytest.fixture(scope="module")
def made(spark):
    return generator.generate_notes(spark, 2000, seed=7).cache()


def test_extraction_finds_the_truth(made):
    truth = {r.file_name: r for r in made.collect()}
    found = records.extract_fields(made.select("raw_text", "file_name")).collect()
    assert len(found) == 2000
    for row in found:
        true = truth[row.file_name]
        for name in ("patient_id", "age", "gender", "diagnosis", "length_of_stay", "prior_admissions"):
            assert row[name] == true[name], (row.file_name, name)
        meds = true.medications and ", ".join(true.medications)
        assert row.medications_raw == meds
        # The truth counts any sentence, the rule only the hyphenated word.
        assert row.has_follow_up == true.follow_up.startswith("Follow-up")
        assert true.has_follow_up == (true.follow_up != "")


def test_planned_faults(made):
    shares = made.agg(
        F.avg(F.isnull("age").cast("int")).alias("age"),
        F.avg(F.isnull("diagnosis").cast("int")).alias("dx"),
        F.avg(F.isnull("medications").cast("int")).alias("meds"),
        F.min("age").alias("youngest"),
        F.max("age").alias("oldest"),
        F.min(F.size("medications")).alias("fewest"),
        F.max(F.size("medications")).alias("most"),
        F.max(F.size(F.array_distinct("medications")) - F.size("medications")).alias("repeats"),
    ).first()
    assert abs(shares.age - 0.10) < 0.03
    assert abs(shares.dx - 0.05) < 0.03
    assert abs(shares.meds - 0.08) < 0.03
    assert (shares.youngest, shares.oldest) == (45, 89)
    assert (shares.fewest, shares.most, shares.repeats) == (2, 5, 0)


def test_seed_fixes_the_notes(spark, made):
    again = generator.generate_notes(spark, 2000, seed=7).repartition(3)
    other = generator.generate_notes(spark, 2000, seed=8)
    assert again.exceptAll(made).isEmpty()
    assert not other.exceptAll(made).isEmpty()


def test_ids_are_never_cut(spark):
    ids = {r.patient_id for r in generator.generate_notes(spark, 10001).select("patient_id").collect()}
    assert {"PAT-0001", "PAT-9999", "PAT-10001"} <= ids
    assert len(ids) == 10001


def test_files_on_disk(spark, made, tmp_path):
    some = made.filter("file_name < 'patient_0011.txt'")
    generator.write_note_files(some, str(tmp_path / "raw"))
    back = readers.read_notes(spark, str(tmp_path / "raw"))
    assert sorted(back.collect()) == sorted(some.select("raw_text", "file_name").collect())


def test_packed_notes_are_read_from_few_files(spark, tmp_path):
    raw, packed = tmp_path / "raw", str(tmp_path / "packed")
    raw.mkdir()
    for i in range(300):
        (raw / f"note {i}+.txt").write_text(f"text {i}\n")
    scans = []

    def scan():
        scans.append(1)
        return readers.read_notes(spark, str(raw))

    assert sinks.pack_notes(spark, packed, scan) and not sinks.pack_notes(spark, packed, scan) and scans == [1]
    found = readers.read_packed(spark, packed)
    assert sorted(found.collect()) == sorted(readers.read_notes(spark, str(raw)).collect()) and found.count() == 300
    assert len(found.inputFiles()) < 10
    assert {r.length for r in spark.read.parquet(packed).collect()} == {7, 8, 9}
    with pytest.raises(FileNotFoundError, match="packed notes"):
        readers.read_packed(spark, str(tmp_path / "none"))


def _files_below(folder):
    return sorted(str(p.relative_to(folder)) for p in pathlib.Path(folder).rglob("*") if p.is_file())


def test_note_folder_is_written_by_the_tasks(spark, tmp_path, monkeypatch):
    """One file per number and nothing beside it; repeated and NULL keys as the writer by folder has them."""
    spark.createDataFrame([(5,), (5,), (7,), (None,), (1_000_009,)], "o_orderkey long").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    mine, other = tmp_path / "mine", tmp_path / "other"
    driver_queries._note_folder(keys, str(mine))
    assert _files_below(mine) == sorted(f"name={n}/note.txt" for n in ("5", "7", "9", "__HIVE_DEFAULT_PARTITION__"))
    monkeypatch.setattr(sinks, "write_text_files", lambda *args: False)
    driver_queries._note_folder(keys, str(other))
    read = lambda folder: sorted(map(tuple, readers.read_notes(spark, str(folder), nested=True, name=readers.folder_name()).collect()))
    assert read(mine) == read(other)


def test_text_files_hold_the_bytes_of_their_value(spark, tmp_path):
    texts = spark.createDataFrame([("a.txt", "one\r\ntwo"), ("deep/b.txt", None), ("c.txt", "")], "path string, value string")
    assert sinks.write_text_files(texts, str(tmp_path))
    found = {name: (tmp_path / name).read_bytes() for name in _files_below(tmp_path)}
    assert found == {"a.txt": b"one\r\ntwo\n", "deep/b.txt": b"\n", "c.txt": b"\n"}


def test_text_file_scan_keeps_repeated_documents(spark, tmp_path):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = driver_queries.text_file_scan(spark, str(tmp_path))
    assert sorted(r.raw_text for r in found.collect()) == ["", "", "a\nb", "a\nb"]
    [folder] = {os.path.dirname(p) for p in map(str, found.inputFiles())}
    assert len(_files_below(folder.removeprefix("file:").replace("///", "/"))) == 4


def test_packed_notes_keep_large_keys_apart(spark, tmp_path):
    """keys a million apart were one note, under the smaller number."""
    keys = [(9,), (1_000_009,), (7_000_009,), (1_000_000,)]
    spark.createDataFrame(keys, "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    found = {r.file_name: r.raw_text for r in driver_queries.packed_note_scan(spark, str(tmp_path)).collect()}
    made = tables.notes_from_orders(spark.createDataFrame(keys, "o_orderkey long"))
    assert found == {str(int(r.file_name[8:-4])): f"{r.raw_text}\n" for r in made.collect()} and len(found) == 4
    # every third one is written anew, from a key a million larger; the name shown is the number's rest
    changed = driver_queries.changed_files(spark, str(tmp_path)).collect()
    anew = tables.notes_from_orders(spark.createDataFrame([(k + 1_000_000 * (k % 3 == 0),) for k, in keys], "o_orderkey long"))
    assert sorted((r.file_name, r.raw_text) for r in changed) == sorted(
        (str(int(r.file_name[8:-4]) % 1_000_000), f"{r.raw_text}\n") for r in anew.collect()
    )


@pytest.mark.parametrize("mounted", [True, False])
def test_text_files_are_listed_in_lots(spark, tmp_path, monkeypatch, mounted):
    """however many files there are, the driver lists a bounded number at once."""
    rows = [(i, None if i == 5 else f"text {i % 40}\r\nend{chr(10) * (i % 3)}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(driver_queries, "LOT_FILES", 30)
    if not mounted:
        monkeypatch.setattr(sinks, "write_text_files", lambda *args: False)
    listed, read = [], readers.read_notes

    def notes(spark, folder, *args, **options):
        listed.append((folder, read(spark, folder, *args, **options).count()))
        return read(spark, folder, *args, **options)

    monkeypatch.setattr(readers, "read_notes", notes)
    found = driver_queries.text_file_scan(spark, str(tmp_path))
    assert len(listed) == 4 and max(n for _, n in listed) < 60 and sum(n for _, n in listed) == 100
    assert sorted(map(tuple, found.collect())) == sorted(((t or "").replace("\r\n", "\n"), True) for _, t in rows)
    assert not any(os.path.exists(folder.removeprefix("file:")) for folder, _ in listed)
