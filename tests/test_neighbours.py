"""Exact nearest neighbours against brute force, by all three ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from noteflow.functions.vectors import first_copies, top_k
from noteflow.operators import neighbours


def frame(spark, key, matrix, ids=None, dtype="bigint"):
    ids = ids if ids is not None else range(len(matrix))
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{key} {dtype}, embedding array<double>")


def brute(queries, vectors, k, ids=None):
    ids = list(ids if ids is not None else range(len(vectors)))
    out = set()
    for q, wanted in enumerate(queries):
        square = ((vectors - wanted) ** 2).sum(1)
        ranked = sorted(range(len(vectors)), key=lambda i: (square[i], ids[i]))[:k]
        out |= {(q, ids[i], rank, round(float(np.sqrt(square[i])), 9)) for rank, i in enumerate(ranked, 1)}
    return out


def found(hits):
    return {(r.query_id, r.vec_id, r["rank"], round(r.distance, 9)) for r in hits.collect()}


def sample(n, width=8, seed=0, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 4
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, width))


# How many rows count as few: all, only the queries, none.
WAYS = {"vectors to queries": 10_000, "queries to vectors": 100, "by pivots": 0}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k", [1, 3])
def test_equals_brute_force(spark, way, k):
    queries, vectors = sample(60, seed=1), sample(900)
    hits = neighbours.nearest(
        frame(spark, "query_id", queries), frame(spark, "vec_id", vectors),
        k, small=WAYS[way], pivots=12, block=100,
    )
    assert found(hits) == brute(queries, vectors, k)


@pytest.mark.parametrize("way", WAYS)
def test_copies_and_hot_group(spark, way):
    """A third of all vectors are one and the same; ties go to the smaller id."""
    vectors = sample(600, seed=2)
    vectors[::3] = vectors[0]
    queries = np.vstack([sample(30, seed=3), vectors[:3]])
    hits = neighbours.nearest(
        frame(spark, "query_id", queries), frame(spark, "vec_id", vectors).repartition(5),
        small=WAYS[way] and 100, pivots=16, block=40,
    )
    assert found(hits) == brute(queries, vectors, 3)


@pytest.mark.parametrize("small", [1000, 2, 0])
def test_fewer_vectors_than_wanted(spark, small):
    queries, vectors = sample(2, seed=4), sample(3, seed=5)
    hits = neighbours.nearest(
        frame(spark, "query_id", queries), frame(spark, "vec_id", vectors), 5, small=small
    )
    assert found(hits) == brute(queries, vectors, 5)


def test_string_ids(spark):
    queries, vectors = sample(5, seed=6), sample(40, seed=7)
    vectors[10:30] = vectors[3]
    ids = [f"doc:{i}" for i in range(40)]
    expected = brute(queries, vectors, 3, ids)
    for small in (1000, 0):
        hits = neighbours.nearest(
            frame(spark, "query_id", queries), frame(spark, "vec_id", vectors, ids, "string"), small=small
        )
        assert found(hits) == expected


def test_rows_without_a_vector_are_passed_over(spark):
    queries = spark.createDataFrame([(0, [0.0]), (1, None)], "query_id bigint, embedding array<float>")
    vectors = spark.createDataFrame([(0, [1.0]), (1, None)], "vec_id bigint, embedding array<float>")
    assert found(neighbours.nearest(queries, vectors)) == {(0, 0, 1, 1.0)}


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("way", WAYS)
def test_bad_vectors_have_no_neighbours_in_any_way(spark, way, partitions):
    """One NaN, NULL or infinite element spoils its own row and no other's result."""
    good = sample(400, seed=10)
    expected = brute(good[:200], good, 3)
    bad = {1000: [float("nan")] + [0.0] * 7, 1001: [None] + [0.0] * 7, 1002: [float("inf")] * 8, 1003: [], 1004: None}

    def spoilt(key, matrix):
        more = spark.createDataFrame(list(bad.items()), f"{key} bigint, embedding array<double>")
        return frame(spark, key, matrix).union(more).repartition(partitions)

    asked, held = spoilt("query_id", good[:200]), spoilt("vec_id", good)
    small = {"vectors to queries": 10_000, "queries to vectors": 300, "by pivots": 0}[way]
    assert found(neighbours.nearest(asked, held, small=small, pivots=12)) == expected
    assert sorted(r.vec_id for r in neighbours.unusable(held).collect()) == sorted(bad)


@pytest.mark.parametrize("way", WAYS)
def test_other_length_is_an_error_in_every_way(spark, way):
    held = frame(spark, "vec_id", sample(150, seed=11)).union(
        spark.createDataFrame([(900, [1.0] * 3), (901, [1.0] * 13)], "vec_id bigint, embedding array<double>")
    )
    asked = frame(spark, "query_id", sample(110, seed=12))
    with pytest.raises(Exception, match="vectors differ in length"):
        neighbours.nearest(asked, held.coalesce(1), small={"vectors to queries": 10_000, "queries to vectors": 120, "by pivots": 0}[way]).collect()


def test_pivots_are_few_on_the_driver(spark):
    """With many partitions no task sends more than its share of the chosen rows."""
    held = frame(spark, "vec_id", sample(3000, seed=13)).repartition(64)
    assert 30 <= len(neighbours._pivots(held, None)) <= 60
    assert len(neighbours._pivots(held, 40)) == 40


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("values", [(1e20, 2e20, 3e20, 4e20), (1e-24, 2e-24, 3e-24, 4e-24), (1.0, 1.00000005, 1.00000008, 1.5), (1e-7, 1e150, 2e150, 3e150)])
def test_large_small_and_close_squares_keep_their_order(spark, way, values):
    vectors = np.array([[v, 0.0] for v in (values[3], values[1], values[0], values[2])])
    far = np.vstack([vectors, 5 * vectors + values[3]] * 1)
    hits = neighbours.nearest(
        frame(spark, "query_id", np.zeros((120, 2))), frame(spark, "vec_id", far), 3, small=WAYS[way] and max(WAYS[way], 119), pivots=3
    )
    assert [(r.vec_id, r["rank"]) for r in hits.where("query_id = 7").orderBy("rank").collect()] == [(2, 1), (1, 2), (3, 3)]


def test_no_vectors(spark):
    none = frame(spark, "vec_id", np.zeros((0, 4)))
    assert neighbours.nearest(frame(spark, "query_id", sample(2, 4)), none).count() == 0


def test_rounding_of_the_matrix_product_does_not_matter():
    """Far from the origin the product loses the digits that tell neighbours apart."""
    rng = np.random.default_rng(8)
    vectors = 1e6 + rng.normal(size=(300, 4)) * 1e-3
    queries = 1e6 + rng.normal(size=(10, 4)) * 1e-3
    rows, cols, _ = top_k(queries, vectors, 3)
    expected = {(q, i) for q, i, _, _ in brute(queries, vectors, 3)}
    assert set(zip(rows.tolist(), cols.tolist())) == expected


def test_pivots_leave_out_far_groups(spark):
    """With clear clusters a query visits few groups, so the work is not all pairs."""
    queries, vectors = sample(200, seed=9, clusters=20), sample(2000, seed=9, clusters=20)
    vectors *= 10
    queries *= 10
    held = neighbours._prepared(frame(spark, "vec_id", vectors), "vec_id")
    asked = neighbours._prepared(frame(spark, "query_id", queries), "query_id")
    centres = neighbours._pivots(held, 40)
    cells = neighbours._cells(neighbours._placed(held, centres), len(centres), 3)
    visits = neighbours._visits(asked, centres, cells, 3).count()
    assert visits < 0.5 * len(queries) * len(centres)


def test_copies_beyond_k_are_passed_over():
    rows = np.array([[1.0, 2], [3, 4], [1, 2], [1, 2], [3, 4], [5, 6], [1, 2]])
    assert first_copies(rows, 1).tolist() == [0, 1, 5]
    assert first_copies(rows, 2).tolist() == [0, 1, 2, 4, 5]
    assert first_copies(rows, 9).tolist() == list(range(7))


@pytest.mark.parametrize("n_vectors, n_queries", [(1, 1), (10, 1), (1, 10**6), (10**9, 10**8), (10**12, 3)])
def test_parts_hold_their_limits(n_vectors, n_queries):
    vector_parts, query_parts = neighbours._parts(n_vectors, n_queries, 2**17)
    held, asked = n_vectors / vector_parts, n_queries / query_parts
    assert held <= 2**17 and asked <= 2**17
    assert held * asked <= neighbours.BLOCK_PAIRS * 1.01
    assert (vector_parts - 1) * (query_parts - 1) <= 4 * n_vectors * n_queries / neighbours.BLOCK_PAIRS


def test_without_structure_a_query_travels_once_per_group(spark, monkeypatch):
    """Every query must see nearly every cell; it goes out once per group of cells, whatever ``pivots`` and ``block`` are."""
    vectors = np.random.default_rng(15).normal(size=(2000, 32))
    sent, made = [], neighbours._visits

    def visits(*args):
        sent.append(made(*args))
        return sent[-1]

    monkeypatch.setattr(neighbours, "_visits", visits)
    hits = neighbours.nearest(frame(spark, "query_id", vectors[:300]), frame(spark, "vec_id", vectors), small=0, pivots=32, block=64)
    assert found(hits) == brute(vectors[:300], vectors, 3)
    assert sum(rows.count() for rows in sent) <= 2 * 300


def test_groups_that_a_task_cannot_hold_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1024 * 8 * 8)
    monkeypatch.setattr(neighbours, "LEAST_PAIRS", 2**12)
    vectors = sample(5000, seed=16)
    vectors[::3] = vectors[0]
    hits = neighbours.nearest(frame(spark, "query_id", vectors[:300]), frame(spark, "vec_id", vectors), small=0, pivots=24, block=50)
    assert found(hits) == brute(vectors[:300], vectors, 3)


def test_groups_take_cells_up_to_the_rows_of_a_task(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 2000 * 8 * 4)
    draw = np.random.default_rng(17)
    size, visits = draw.integers(0, 900, 60), np.append(draw.integers(0, 50, 60), 80)
    size[7], visits[7] = 9000, 60
    group, parts = neighbours._groups(draw.normal(size=(60, 4)), size, visits, 4)
    assert ((group >= 0) == ((size > 0) & (visits[:-1] > 0))).all()
    for g, (vector_parts, query_parts) in enumerate(parts):
        assert size[group == g].sum() <= 2000 * vector_parts and min(visits[:-1][group == g].sum(), 80) <= 2000 * query_parts
    assert len(parts) <= 2 * size.sum() / 2000 + 2


def test_search_in_groups_bounds_its_candidates(monkeypatch):
    """Where rounding leaves all vectors candidates, they are settled as they come."""
    from noteflow.functions import vectors as functions

    monkeypatch.setattr(functions, "MOST_CANDIDATES", 500)
    rng = np.random.default_rng(18)
    vectors, queries = 1e6 + rng.normal(size=(400, 4)) * 1e-3, 1e6 + rng.normal(size=(10, 4)) * 1e-3
    group = rng.integers(0, 5, 400)
    everything = lambda q, groups: (np.ones((len(q), len(groups)), bool), np.zeros((len(q), len(groups))))
    rows, cols, square = functions.top_k_in_groups(queries, vectors, group, everything, 3, 32)
    assert {(q, i, round(float(np.sqrt(s)), 9)) for q, i, s in zip(rows.tolist(), cols.tolist(), square)} == {
        (q, i, d) for q, i, _, d in brute(queries, vectors, 3)
    }


def test_queries_travel_in_lots_and_vectors_stay(spark, monkeypatch):
    """the driver holds a lot of queries at a time; both sides meet without a shuffle of either."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1024 * 8 * 8)
    vectors = sample(5000, seed=31)
    vectors[::3] = vectors[0]
    queries, lots, made = vectors[:3000], [], neighbours._lots

    def spied(packed, rows):
        for lot in made(packed, rows):
            lots.append(sum(pa.ipc.open_stream(part).read_all().num_rows for part in lot))
            yield lot

    monkeypatch.setattr(neighbours, "_lots", spied)
    asked, held = frame(spark, "query_id", queries), frame(spark, "vec_id", vectors)
    hits = found(neighbours.nearest(asked, held, small=0, pivots=24, block=100))
    assert len(lots) > 1 and sum(lots) == 3000 and max(lots) < 2 * 1024
    few = [*range(0, 3000, 97)]
    assert len(hits) == 9000 and {h for h in hits if h[0] in few} == {(few[q], *rest) for q, *rest in brute(queries[few], vectors, 3)}


@pytest.mark.parametrize("scale", [1.0, 1e-24, 1e140])
@pytest.mark.parametrize("at", [0.0, 1e3])
def test_short_products_narrow_and_bounds_leave_out(scale, at):
    """Products of 32 bits tell little far from the origin; the result is that of the 64 bits ones, within a bound too."""
    from noteflow.functions.vectors import squared_distances, top_k_in_groups

    draw = np.random.default_rng(32)
    vectors, queries = scale * (at + draw.normal(size=(700, 6))), scale * (at + draw.normal(size=(90, 6)))
    vectors[::4] = vectors[0]
    group, marks = draw.integers(0, 9, 700), draw.random((90, 9)) < 0.6
    visits = lambda q, groups, marks: (marks[:, groups], np.zeros((len(q), len(groups))))
    away = np.sqrt(((queries[:, None] / scale - vectors[None] / scale) ** 2).sum(2))
    away[~marks[:, group]] = np.inf
    best = np.sort(away, axis=1)[:, 2]
    for bound in (None, best * scale, best * scale * 0.9):
        rows, cols, square = top_k_in_groups(queries, vectors, group, visits, 3, 32, bound, marks)
        got = {(q, round(d, 6)) for q, d in zip(rows.tolist(), np.sqrt(square) / scale)}
        # what lies beyond the bound may be left out, nothing that lies within it
        wanted = {(q, round(float(d), 6)) for q in range(90) for d in np.sort(away[q])[:3] if bound is None or d * scale <= bound[q]}
        assert wanted <= got and len(rows) == len(set(zip(rows.tolist(), cols.tolist()))) and all(marks[q, group[c]] for q, c in zip(rows, cols))
        if bound is None:
            assert len(rows) == 270
    assert squared_distances(queries, vectors).shape == away.shape
