"""Every query of this folder on awkward, empty and ordinary tables, against plain Python or SQL."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from brute import base_licenses, byte_bpe, components, contained, edited, fingerprinted, line_dedup, substring_dedup

import __spark_entry__ as driver
from noteflow.llm import license_scan, queries
from tools.check_oracles import compare, connect

# names that the operators use inside
EXTRA = "row long, count long, score double, keep string, bits long, label string, text_hash long, place int"


def awkward_texts() -> list[tuple[int | None, str | None]]:
    draw = random.Random(7)
    word = lambda: "".join(draw.choice(["ba", "ne", "lo", "ti", "ßu", "É", "x1"]) for _ in range(draw.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, long = text(60), "A line of some length, shared.", text(3000)
    base = text(200)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "MIT License, Apache license;\nGNU General Public License"),
        (6, f"{text(40)} {passage} {text(9)}"), (7, f"{passage}\n{line}\n{line}"), (8, f"{text(50)}\n  {line.upper()}\t\n"),
        (9, f"{line}\n{text(3)}"), (10, f"{line}\r\n{passage} {passage}"), (11, base), (12, " ".join(near)), (13, base),
        (14, long), (15, "a " * 400), (16, "日本語 текст 🙂🙂 …\x00\x1c end" * 3), (17, "\n\n\n"), (18, "same same same"),
        (100, base), (200, f"Released under the very MIT license. {text(30)} licensed under the Apache license version 3 0"),
        (-5, "negative id"), (2**40, f"{long[:500]}"),
    ]
    return [r for r in rows]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    rows = awkward_texts()
    rows += [(11, rows[10][1]), (None, "a text without an id"), (None, "a text without an id"), (18, "other text of one id")]
    kind = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    values = [(d, t, ("en", "de", None)[i % 3], None, None, 1, 1, 1.0, "k", 1, "l", 1, 1) for i, (d, t) in enumerate(rows)]
    spark.createDataFrame(values, kind).repartition(3).write.parquet(f"{folder}/documents.parquet")
    passage = " ".join(rows[5][1].split()[40:100])
    items = [(1, passage), (2, "too short"), (3, None), (None, rows[10][1]), (4, passage), (5, " ".join(rows[13][1].split()[500:540]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(d, 1, i % 2) for i, (d, _) in enumerate(rows)] + [(3, None, None), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(i % 3), -1.0, 0.5], i % 4, 1) for i in range(60)] + [(None, [1.0, 2.0, 3.0], 1, 1), (7, None, 2, 1), (8, [0.0, 0.0, 0.0], 3, 1)]
    vectors += [(100, [1.0], 1, 1), (200, [float("nan"), 1.0, 1.0], 1, 1), (300, [float("inf"), 1.0, 1.0], 1, 1), (400, [None, 1.0, 1.0], 1, 1), (0, [0.0, -1.0, 0.5], 0, 1), (500, [], 1, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, score int").write.parquet(f"{folder}/embeddings.parquet")
    turns = [(1, 0, "user", None), (1, None, None, "x"), (None, 1, "user", "y"), (20, 0, "user", "z")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, rows, items


@pytest.fixture(scope="module")
def distinct_ids(spark, tmp_path_factory):
    folder, rows = str(tmp_path_factory.mktemp("distinct")), awkward_texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory, sf_dir):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def named(spark, name, folder, *columns):
    return sorted((tuple(r) for r in driver.queries()[name](spark, folder).select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", [*queries.ALL, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert driver.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [*queries.ALL, "pipeline"])
def test_awkward_tables_run(spark, awkward, name):
    folder, rows, _ = awkward
    found = driver.queries()[name](spark, folder).collect()
    if name not in ("op4_decontamination", "pipeline") and "doc_id" in found[0]:
        assert sorted((r.doc_id for r in found), key=repr) == sorted((d for d, _ in rows), key=repr)


def test_substring_dedup(spark, awkward):
    folder, rows, _ = awkward
    assert named(spark, "op2_substring_dedup", folder, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(substring_dedup(rows), key=repr)


def test_decontamination(spark, awkward):
    folder, rows, items = awkward
    columns = ["doc_id", "item_id", "n_shared", "n_shingles", "containment"]
    assert named(spark, "op4_decontamination", folder, *columns) == sorted(contained(rows, items), key=repr)


def test_byte_bpe(spark, awkward):
    folder, rows, _ = awkward
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = named(spark, "op5_byte_bpe", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(byte_bpe(rows, path, public_tokenizers.PATTERN), key=repr)


def test_base_licenses(spark, awkward):
    folder, rows, _ = awkward
    found = named(spark, "op6_license_scan", folder, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == sorted(base_licenses(rows, license_scan.PHRASES), key=repr)


def test_line_dedup(spark, awkward):
    folder, rows, _ = awkward
    assert named(spark, "op8_line_dedup", folder, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(line_dedup(rows), key=repr)


def test_components(spark, awkward):
    folder, rows, _ = awkward
    assert named(spark, "op9_simhash_dedup", folder, "doc_id", "fingerprint", "component_id") == sorted(components(rows), key=repr)


def test_edited_texts(spark, distinct_ids):
    folder, rows = distinct_ids
    assert named(spark, "op7_fingerprints", folder, "doc_id", "n_chars", "edited_sha256") == sorted(edited(rows), key=repr)


def test_fingerprints_and_likeness(spark, distinct_ids):
    folder, rows = distinct_ids
    columns = ["doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]
    assert named(spark, "op7_fingerprints", folder, *columns) == sorted(fingerprinted(rows), key=repr)


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, sf_dir).startswith("equal")
