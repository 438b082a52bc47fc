"""The projection forest and the R-tree against all pairs."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as driver
from noteflow.llm import hard_negatives, projection_forest


def frame(spark, rows, kind="vec_id long, embedding array<float>"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], kind).repartition(5)


def clusters(seed, n, width, centres):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    return (middle[draw.integers(0, centres, n)] + 0.3 * draw.normal(size=(n, width))).astype(np.float32)


def nearest(queries, rows, k):
    """``query_id, rank, vec_id`` and scores by comparing all; rows are told apart by their place."""
    out = {}
    for q, (query_id, query, place) in enumerate(queries):
        found = [(-float(np.dot(np.float64(query), np.float64(v))), i) for p, (i, v) in enumerate(rows) if p != place]
        out[q, query_id] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def asked(rows, every):
    return [(i, v, p) for p, (i, v) in enumerate(rows) if i is not None and i % every == 0]


def found_of(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in found.items()}


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 64, "query_rows": 3, "leaf": 16, "trees": 3}])
def test_exact_when_every_leaf_is_visited(spark, settings):
    rows = list(enumerate(clusters(1, 700, 12, 9)))
    frames = frame(spark, [r for r in rows if r[0] % 20 == 0]), frame(spark, rows)
    found = found_of(projection_forest.search(*frames, k=7, recall=1.0, **settings))
    expected = nearest(asked(rows, 20), rows, 7)
    assert len(found) == len(expected)
    for (_, query_id), best in expected.items():
        assert [(r, i) for r, i, _ in found[query_id]] == [(n + 1, i) for n, (i, _) in enumerate(best)]
        assert np.allclose([s for *_, s in found[query_id]], [s for _, s in best], rtol=1e-14, atol=0)


@pytest.mark.parametrize("centres, n", [(400, 6000), (1, 3000)])
def test_recall(spark, centres, n):
    rows = list(enumerate(clusters(2, n, 24, centres)))
    found = found_of(projection_forest.search(frame(spark, [r for r in rows if r[0] % 20 == 0]), frame(spark, rows)))
    true = nearest(asked(rows, 20), rows, 20)
    met = [len({i for _, i, _ in found[q]} & {i for i, _ in best}) / len(best) for (_, q), best in true.items()]
    assert np.mean(met) >= 0.9 and all(len(found[q]) == 20 for _, q in true)


def test_clusters_need_few_leaves():
    rows = clusters(3, 20_000, 32, 500)
    forest = [projection_forest.fit_tree(rows, 64, seed) for seed in range(4)]
    sizes = [np.bincount(t.place(rows), minlength=t.leaves) for t in forest]
    assert all(s.max() <= 64 for s in sizes)
    score = rows @ rows[5]
    best = set(np.argsort(-score)[1:21].tolist())
    met = set()
    for number, leaf in projection_forest.visited(forest, sizes, rows[5].astype(float), 2500):
        met |= set(np.flatnonzero(forest[number].place(rows) == leaf).tolist())
    assert len(met & best) >= 18 and len(met) <= 2600


def test_the_queue_gives_every_leaf_once_and_the_own_one_first():
    rows = clusters(4, 500, 8, 5)
    forest = [projection_forest.fit_tree(rows, 20, seed) for seed in range(3)]
    given = list(projection_forest.queue(forest, rows[0].astype(float)))
    assert sorted(given) == [(n, leaf) for n, t in enumerate(forest) for leaf in range(t.leaves)]
    assert set(given[:3]) == {(n, int(t.place(rows[:1])[0])) for n, t in enumerate(forest)}


def test_one_vector_held_by_a_third_of_all_rows(spark):
    rows = [(i, v) for i, v in enumerate(clusters(5, 900, 6, 3))]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows] + [(0, rows[0][1]), (60, rows[0][1]), (61, rows[1][1])]
    frames = frame(spark, [r for r in rows if r[0] % 20 == 0]), frame(spark, rows)
    found = projection_forest.search(*frames, k=5, recall=1.0).collect()
    expected = nearest(asked(rows, 20), rows, 5)
    flat = sorted((q, n + 1, i) for (_, q), best in expected.items() for n, (i, _) in enumerate(best))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == flat


def test_vectors_that_take_no_part(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [math.nan, 1.0]), (100, [1.0, None]), (120, [math.inf, 1.0]), (140, [1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (-20, [3.0, 1.0])]
    kind = "vec_id long, embedding array<double>, query long, place int"
    rows = spark.createDataFrame([(i, v, 1, 1) for i, v in bad + good], kind)
    found = projection_forest.search(rows.where("vec_id % 20 = 0"), rows, k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [
        (-20, 1, 0, 3.0), (-20, 2, 1, 2.0), (-20, 3, 2, -3.0), (0, 1, -20, 3.0), (0, 2, 1, 0.5), (0, 3, 2, -1.0),
    ]
    nothing = spark.createDataFrame([], kind)
    assert projection_forest.search(rows, nothing).collect() == [] and projection_forest.search(nothing, rows).collect() == []


def test_forest_query_has_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = found_of(driver.queries()["op11_projection_forest"](spark, sf_dir))
    true = nearest(asked(rows, 20), rows, 20)
    assert np.mean([len({i for _, i, _ in found[q]} & {i for i, _ in best}) / len(best) for (_, q), best in true.items()]) >= 0.9


# ---- hard negatives ----------------------------------------------------------

def mined(rows, every=100, positives=5, negatives=5):
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` by comparing all; Python's integers."""
    out = []
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    for p, (anchor, label, v) in enumerate(rows):
        if anchor % every:
            continue
        others = [(-dot(v, w), i, n) for q, (i, n, w) in enumerate(rows) if q != p]
        for score, positive, _ in sorted((s, i, n) for s, i, n in others if n == label)[:positives]:
            held = sorted((s, i) for s, i, n in others if n != label and 80 * -score <= 100 * -s <= 100 * -score)
            out += [(anchor, positive, k + 1, i, -score, -s) for k, (s, i) in enumerate(held[:negatives])]
    return sorted(out)


def drawn(seed, n, width, labels, spread=40):
    draw = np.random.default_rng(seed)
    middle = draw.integers(-60, 60, (6, width))
    return [(i, int(draw.integers(0, labels)), (middle[draw.integers(0, 6)] + draw.integers(-spread, spread, width)).tolist()) for i in range(n)]


def answers(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<int>").repartition(4)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hard_negatives.mine(df.where("vec_id % 100 = 0"), df, **settings).select(columns).collect())


@pytest.mark.parametrize("seed, width, labels, settings", [
    (1, 5, 3, {}), (2, 9, 7, {"shard_rows": 100, "query_rows": 2}), (3, 2, 2, {"shard_rows": 60}), (4, 16, 400, {"shard_rows": 128}),
])
def test_mining_against_all_pairs(spark, seed, width, labels, settings):
    rows = drawn(seed, 1200, width, labels)
    assert answers(spark, rows, **settings) == mined(rows)


def test_ties_copies_and_repeated_rows(spark):
    rows = [(i, i % 2, [4, 3]) for i in range(0, 600, 3)] + [(i, i % 2, [3 + i % 2, 4]) for i in range(1, 600, 3)]
    rows += [(100, 0, [4, 3]), (100, 0, [4, 3]), (100, 0, [5, 5]), (100, 1, [1, 2]), (300, 0, [0, 0]), (0, 1, [-2, 1])]
    assert answers(spark, rows, shard_rows=50) == mined(rows)


def test_large_numbers(spark):
    draw = np.random.default_rng(9)
    rows = [(i * 10, int(draw.integers(0, 2)), [int(x) for x in draw.integers(2**29, 2**29 + 2**20, 8)]) for i in range(150)]
    assert answers(spark, rows, shard_rows=40) == mined(rows)


def test_query_on_awkward_vectors(spark, tmp_path):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=4).tolist(), int(draw.integers(-3, 4)), 1) for i in range(-200, 500)]
    bad = [(100, None, 1, 1), (200, [1.0, None, 1.0, 1.0], 1, 1), (300, [math.nan] * 4, 1, 1), (400, [math.inf] * 4, 1, 1), (0, [1.0], 1, 1)]
    bad += [(700, [1.0] * 4, None, 1), (None, [1.0] * 4, 2, 1), (800, [1e30] * 4, 1, 1), (900, [], 1, 1)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, query int")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, int(np.fmod(n + 1, 10)) if i % 7 == 0 else n, [math.floor(256 * x) for x in v]) for i, v, n, _ in rows]
    found = driver.queries()["op12_hard_negatives"](spark, str(tmp_path))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == mined(moved)


def test_boxes_hold_their_rows_and_prune():
    rows = np.array([v for *_, v in drawn(6, 3000, 4, 5, spread=4)])
    labels, ids = np.arange(3000) % 5, np.arange(3000)
    tree = hard_negatives.pack(rows, labels, ids, page=32)
    for level in tree.levels:
        least, most = hard_negatives.intervals(level["low"], level["high"], rows[0])
        assert (least <= most).all()
    score = tree.rows @ rows[0]
    pages = list(zip(tree.begins, tree.begins[1:]))
    least, most = hard_negatives.intervals(tree.levels[0]["low"], tree.levels[0]["high"], rows[0])
    assert all(low <= score[a:b].min() and score[a:b].max() <= high for (a, b), low, high in zip(pages, least, most))
    met: dict = {}
    found = hard_negatives.best_first(tree, rows[0], 0, True, 5, scores=met)
    assert found == sorted(((int(rows[i] @ rows[0]), i) for i in range(0, 3000, 5)), key=lambda x: (-x[0], x[1]))[:5]
    assert len(met) < len(pages) / 4
