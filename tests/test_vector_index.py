"""The kept search structure: equal to a fresh search, and nothing is placed again."""

from __future__ import annotations

import glob

import numpy as np
import pytest
from helpers import final_plan
from pyspark.sql import functions as F
from test_neighbours import brute, found, frame, sample

from noteflow.operators import neighbours, vector_index


@pytest.fixture
def index(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.build(frame(spark, "vec_id", sample(900)), path, pivots=40)
    return path


def files(path):
    return sorted(glob.glob(f"{path}/placed/*.parquet"))


def test_equals_brute_force_and_places_nothing_again(spark, index, monkeypatch):
    queries, before = sample(60, seed=1), files(index)
    monkeypatch.setattr(neighbours, "_placed", None)
    monkeypatch.setattr(neighbours, "_pivots", None)
    for k, small in ((1, 0), (3, 0), (3, 100)):
        hits = vector_index.search(frame(spark, "query_id", queries), index, k, small)
        assert found(hits) == brute(queries, sample(900), k)
    assert files(index) == before


def test_one_query_reads_the_cells_it_visits(spark, index):
    """Files whose cells cannot hold a neighbour are not read."""
    hits = vector_index.search(frame(spark, "query_id", sample(900)[:1]), index, 1)
    assert found(hits) == {(0, 0, 1, 0.0)}
    held = vector_index.vectors(spark, index)
    assert "PushedFilters" in final_plan(held.where(F.col("cell").isin([3]))) or held.where("cell = 3").count() < 900
    cells = [{r.cell for r in spark.read.parquet(f).select("cell").distinct().collect()} for f in files(index)]
    assert len(cells) >= 2 and max(map(len, cells)) < 40  # a file holds some cells, not all


def test_added_and_deleted_vectors(spark, index):
    more, queries = sample(200, seed=7), sample(50, seed=8)
    ids = list(range(1000, 1200))
    assert vector_index.add(frame(spark, "vec_id", more, ids), index) == 2
    both, both_ids = np.vstack([sample(900), more]), [*range(900), *ids]
    asked = frame(spark, "query_id", queries)
    assert found(vector_index.search(asked, index)) == brute(queries, both, 3, both_ids)

    gone = [i for i in both_ids if i % 3 == 0]
    vector_index.delete(spark.createDataFrame([(i,) for i in [*gone, 77_777]], "vec_id bigint"), index)
    left = [n for n, i in enumerate(both_ids) if i % 3]
    assert found(vector_index.search(asked, index)) == brute(queries, both[left], 3, [both_ids[n] for n in left])

    # one comes back with another vector, one that stands is replaced
    back = sample(2, seed=9)
    assert vector_index.add(frame(spark, "vec_id", back, [0, 1]), index) == 4
    left = [n for n in left if both_ids[n] != 1]
    now, now_ids = np.vstack([both[left], back]), [*[both_ids[n] for n in left], 0, 1]
    assert found(vector_index.search(asked, index)) == brute(queries, now, 3, now_ids)
    # equal to an index built anew from the same rows
    fresh = f"{index}-fresh"
    vector_index.build(frame(spark, "vec_id", now, now_ids), fresh)
    assert found(vector_index.search(asked, fresh)) == found(vector_index.search(asked, index))


def test_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "index"), []

    def vectors():
        calls.append(1)
        return frame(spark, "vec_id", sample(50))

    assert vector_index.build_once(spark, path, vectors) and not vector_index.build_once(spark, path, vectors)
    assert calls == [1]


def test_awkward_vectors(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, [0.0, 0.0], "a"), (2, None, "b"), (3, [float("nan"), 1.0], "c"), (4, [3.0, 4.0], "d"), (5, [3.0, 4.0], "e")]
    vector_index.build(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, chunk string"), path)
    asked = spark.createDataFrame([(0, [3.0, 4.0]), (1, None)], "query_id bigint, embedding array<float>")
    assert found(vector_index.search(asked, path, 2)) == {(0, 4, 1, 0.0), (0, 5, 2, 0.0)}
    assert {r.chunk for r in vector_index.vectors(spark, path).collect()} == {"a", "d", "e"}
    with pytest.raises(FileNotFoundError, match="vector index"):
        vector_index.vectors(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="cell"):
        vector_index.build(spark.createDataFrame([(1, [0.0], 3)], "vec_id bigint, embedding array<float>, cell int"), path)
    empty = str(tmp_path / "empty")
    vector_index.build(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), empty)
    assert vector_index.search(asked, empty).collect() == []
    assert vector_index.add(frame(spark, "vec_id", np.array([[1.0, 1.0]])), empty) == 1
    assert vector_index.search(asked, empty).count() == 1


def test_many_questions_travel_once_per_group(spark, tmp_path, monkeypatch):
    """Vectors without structure: a question must see nearly every cell of the index."""
    vectors = np.random.default_rng(21).normal(size=(1500, 32))
    path, sent, made = str(tmp_path / "index"), [], neighbours._visits
    vector_index.build(frame(spark, "vec_id", vectors), path, pivots=30)

    def visits(*args):
        sent.append(made(*args))
        return sent[-1]

    monkeypatch.setattr(neighbours, "_visits", visits)
    assert found(vector_index.search(frame(spark, "query_id", vectors[:200]), path, small=0)) == brute(vectors[:200], vectors, 3)
    assert sum(rows.count() for rows in sent) <= 2 * 200
