"""Contexts and keywords."""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import numpy as np
import pandas as pd
from helpers import final_plan, plan

from noteflow.functions.text import HashedWords, split_text
from noteflow.operators import neighbours, retrieval, vector_index
from noteflow.plans import driver_queries
from noteflow.sources import readers, sinks, tables


def test_context_is_best_first_and_empty_without_hits(spark):
    questions = spark.createDataFrame([("q1", "a"), ("q2", ""), ("q3", None)], "query_id string, text string")
    hits = spark.createDataFrame(
        [("q1", "v2", 1), ("q1", "v9", 2), ("q1", "v1", 3)], "query_id string, vec_id string, rank int"
    )
    chunks = spark.createDataFrame([("v1", "one"), ("v2", "two"), ("v9", "nine")], "vec_id string, chunk string")
    rows = {r.query_id: r.context for r in retrieval.context(questions, hits, chunks).collect()}
    assert rows == {"q1": "two\n\nnine\n\none", "q2": "", "q3": ""}


GUIDE = "\n\n".join(
    f"{topic} {'detail ' * 40}{topic} end." for topic in ("sepsis", "pneumonia", "fracture", "stenosis", "diabetes")
)


def in_order(squares):
    """Row sums, element after element, as the search adds them up."""
    return np.cumsum(squares, axis=1)[:, -1]


def test_retrieve_context_against_brute_force(spark, tmp_path):
    documents = spark.createDataFrame([("guide", GUIDE), ("extra", "sepsis and diabetes")], "doc_id string, text string")
    sinks.write_vectors(retrieval.vector_table(documents), str(tmp_path / "vectors"))
    vectors = readers.read_vectors(spark, str(tmp_path / "vectors"))
    asked = {"q1": "Who has sepsis?", "q2": "pneumonia or fracture", "q3": ""}
    questions = spark.createDataFrame(list(asked.items()), "query_id string, text string")

    chunks = {f"guide:{i}": c for i, c in enumerate(split_text(GUIDE))} | {"extra:0": "sepsis and diabetes"}
    encode = HashedWords()()
    matrix = encode(pd.Series(chunks.values()))
    expected = {}
    for name, text in asked.items():
        square = in_order((matrix - encode(pd.Series([text]))[0]) ** 2)
        best = sorted(zip(square, chunks))[:3] if text else []
        expected[name] = "\n\n".join(chunks[vec_id] for _, vec_id in best)

    found = retrieval.retrieve_context(questions, vectors)
    assert {r.query_id: r.context for r in found.collect()} == expected


def test_registered_retrieval_against_brute_force(spark, sf_dir):
    """The whole-table query, on the smallest tables."""
    found = {r.query_id: r.context for r in driver_queries.retrieve_context(spark, sf_dir).collect()}
    chunks = {}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        chunks |= {f"{doc.doc_id}:{i}": c for i, c in enumerate(split_text(doc.text))}
    ids = sorted(chunks)
    encode = HashedWords()()
    matrix = encode(pd.Series([chunks[i] for i in ids]))
    questions = driver_queries.questions(spark, sf_dir).collect()
    assert len(found) == len(questions)
    for question in questions:
        square = in_order((matrix - encode(pd.Series([question.text]))[0]) ** 2)
        best = np.lexsort((np.arange(len(ids)), square))[:3]
        assert found[question.query_id] == "\n\n".join(chunks[ids[i]] for i in best)


def test_registered_chunks_equal_the_splitter(spark, sf_dir):
    rows = driver_queries.chunk_documents(spark, sf_dir).collect()
    found = {(r.doc_id, r.chunk_ix): r.chunk for r in rows}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found == {(d.doc_id, i): c for d in documents for i, c in enumerate(split_text(d.text))}


def test_keywords_against_brute_force(spark):
    texts = {"a": "Sepsis risk, sepsis care", "b": "risk of fracture", "c": "the risk", "d": ""}
    questions = spark.createDataFrame(list(texts.items()), "query_id string, text string")
    words = {q: re.findall(r"[^\W_]+", t.lower()) for q, t in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    expected = set()
    for q, ws in words.items():
        score = {w: round(n * math.log(len(texts) / df[w]), 6) for w, n in Counter(ws).items()}
        for rank, w in enumerate(sorted(score, key=lambda w: (-score[w], w))[:2], 1):
            expected.add((q, w, score[w], rank))
    assert {tuple(r) for r in retrieval.keywords(questions, 2).collect()} == expected


def test_hot_join_keys_are_split(spark, set_conf):
    """A word, or a chunk, that a large share of rows joins on is split by size."""
    set_conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    set_conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    set_conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20k")
    set_conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10k")
    set_conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    # Tiny shuffles would be merged into one task, which leaves nothing to split.
    set_conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ids = spark.range(40000, numPartitions=16)
    questions = ids.selectExpr("cast(id as string) query_id", "concat('risk ', if(id % 40 = 0, string(id), '')) text")
    assert "SortMergeJoin(skew=true)" in final_plan(retrieval.keywords(questions).filter("rank < 9"))

    hits = ids.selectExpr("id query_id", "if(id % 3 = 0, 7, id) vec_id", "1 rank")
    chunks = ids.selectExpr("id vec_id", "cast(id as string) chunk")
    joined = retrieval.context(ids.selectExpr("id query_id"), hits, chunks)
    assert "SortMergeJoin(skew=true)" in final_plan(joined)
    assert joined.filter("context = '7'").count() == 13334 + 1
    assert joined.count() == 40000


def test_plans(spark, sf_dir):
    held = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = held.withColumnRenamed("vec_id", "query_id")
    for small in (4096, 0):
        text = plan(neighbours.nearest(asked, held, small=small))
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "WindowGroupLimit" in text
    # A filter on the vector must not run the embedder twice.
    text = plan(retrieval.embed(held.selectExpr("cast(vec_id as string) t"), "t", HashedWords()).filter("size(embedding) > 0"), "simple")
    assert text.count("ArrowEvalPython") == 1


def test_words_as_column_expressions_equal_the_python_ones(spark, sf_dir):
    texts = ["", None, "One one TWO", "été ÉTÉ x1 x-1", "!?", "日本語 текст " * 50, "w " * 30_000]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], "id int, text string, `a.b` string, _words int")
    for width in (64, 1000):
        found = retrieval.embed(rows, "text", width=width)
        expected = HashedWords(width)()(pd.Series([t or "" for t in texts]))
        got = {r.id: r.embedding for r in found.collect()}
        assert all(np.array_equal(got[i], expected[i]) for i in range(len(texts)))
        sparse = {r.id: r.held for r in retrieval.word_counts(rows, "text", width, "held").collect()}
        assert all(sparse[i].indices == np.flatnonzero(expected[i]).tolist() for i in range(len(texts)))
    assert found.columns == [*rows.columns, "embedding"] and found.first()["a.b"] == "kept"


def test_default_embedder_runs_no_python(spark, sf_dir):
    for df in (driver_queries.hashed_embeddings(spark, sf_dir), retrieval.embed(spark.createDataFrame([("x",)], "text string"), "text")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text


def test_many_hits_stay_off_the_driver(spark, monkeypatch):
    """However few bytes they are on disk."""
    monkeypatch.setattr(retrieval, "BROADCAST_HITS", 3)
    questions = spark.createDataFrame([(f"q{i}", "a") for i in range(4)], "query_id string, text string")
    hits = spark.createDataFrame([(f"q{i}", f"v{i % 2}", 1) for i in range(4)], "query_id string, vec_id string, rank int")
    chunks = spark.createDataFrame([("v0", "one"), ("v1", "two")], "vec_id string, chunk string")
    found = retrieval.context(questions, hits, chunks)
    assert re.search(r"SortMergeJoin(\(.*?\))? \[vec_id", final_plan(found)) and not re.search(r"BroadcastHashJoin \[vec_id", final_plan(found))
    assert {r.query_id: r.context for r in found.collect()} == {"q0": "one", "q1": "two", "q2": "one", "q3": "two"}


def test_chunk_index_holds_the_default_vectors_once(spark, sf_dir):
    """chunks are embedded where they are cut; what the index was built from goes."""
    path = driver_queries.chunk_index(spark, sf_dir)
    held = vector_index.vectors(spark, path).select("vec_id", "chunk", "embedding")
    again = retrieval.vector_table(tables.documents(spark, sf_dir))
    assert held.exceptAll(again).isEmpty() and again.exceptAll(held).isEmpty() and held.count() > 100
    work = os.path.dirname(path).removeprefix("file:")
    assert not any(os.listdir(os.path.join(work, name)) for name in os.listdir(work) if name.startswith("chunk-vectors"))


def test_many_words_are_counted_as_one_by_one():
    texts = ["", None, "One one TWO", "é É x1_x-1 ΣΑΣ", "w " * 5000] * 300
    matrix = HashedWords(3000)()(pd.Series(texts))
    for text, row in zip(texts[:5], matrix):
        assert np.array_equal(row, HashedWords(3000)()(pd.Series([text]))[0])
    assert np.array_equal(matrix[-5:], matrix[:5])
