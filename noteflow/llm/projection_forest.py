"""Approximate nearest neighbours by a forest of random-projection trees.

A tree's node splits space by a plane: its normal is the difference of two random vectors of the
node, freed from the normals above it, the best spread of ``DRAWS`` such; its offset is the median.
The trees are fitted on a bounded sample (``FIT_BYTES``) and then every row is placed in one
leaf of each tree. A query searches all trees through one priority queue: it takes the node whose
cell is nearest (the squared distances to the planes that lie between, added up), goes down the near
side and puts the far side back, until the leaves it has met hold ``budget`` rows. The rows of these
leaves are ranked by their exact inner products.

``budget`` is measured, not guessed: for ``CALIBRATION`` queries at most the true neighbours are found by
comparing them with all rows, and the queue says how many rows it takes to meet each of them. The budget
is the least that meets the share ``recall`` of them, so it is small for vectors that lie in
clusters, and near half of all rows for vectors without any structure. ``recall=1.0`` visits
every leaf: the exact answer by the same way.

Scale: leaves beside each other form cells of about ``CELL_ROWS`` rows, a leaf with more is cut into parts by
a hash, so no group grows with the table; a query goes once to each cell, with the list of its leaves.
Each vector is shuffled once per tree. Of equal vectors only the first k + 1 can be among k neighbours; the
others are folded before, partly ahead of the shuffle, and equal queries are searched once. What is
broadcast is the forest: ``FIT_BYTES`` per tree at most.

Defined results: rows without an id, and vectors that are NULL, empty, zero, of another length than the most frequent one or that hold
a NULL, NaN or infinite element take no part. Repeated rows are rows of their own: each is the
others' candidate and each gives its own answer. No query or no candidate, no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import written
from . import common
from .vectors import chosen, finite, matrix

TREES = 4
#: Rows of a leaf that the depth of the trees aims at.
LEAF = 128
FIT_BYTES = 16 << 20
DRAWS = 4
#: Queries at most whose true neighbours set the budget.
CALIBRATION = 256
RECALL = 0.95
CELL_ROWS = 1 << 15
QUERY_ROWS = 1 << 13
SEED = 11


@dataclass
class Tree:
    """Node i splits by ``normals[i] . x > offsets[i]``; children below zero are leaves, -1 - leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    low: list[int]
    high: list[int]
    leaves: int

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        low, high = np.array(self.low, np.int64), np.array(self.high, np.int64)
        at = np.full(len(rows), 0 if len(low) else -1, np.int64)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            over = np.einsum("ij,ij->i", rows[inner], self.normals[node]) > self.offsets[node]
            at[inner] = np.where(over, high[node], low[node])
        return -1 - at


def fit_tree(sample: np.ndarray, leaf: int, seed: int) -> Tree:
    """A tree over ``sample`` whose leaves hold ``leaf`` rows of it at most, unless these are all alike."""
    draw = np.random.default_rng(seed)
    normals, offsets, low, high, leaves = [], [], [], [], 0

    def split(rows: np.ndarray, above: list[np.ndarray]):
        best = None
        for _ in range(DRAWS):
            one, other = draw.choice(len(rows), 2, replace=False)
            normal = sample[rows[one]].astype(np.float64) - sample[rows[other]]
            for way in above:
                normal -= (normal @ way) * way
            size = np.linalg.norm(normal)
            if size > 1e-9 * (1e-300 + np.abs(sample[rows[one]]).max()):
                along = sample[rows] @ (normal / size)
                if best is None or along.std() > best[1].std():
                    best = normal / size, along
        if best is None:
            return None
        offset = np.median(best[1])
        over = best[1] > offset
        return (best[0], offset, over) if over.any() and not over.all() else None

    # children are numbered when their parent is taken up, so leaves come in order from left to right
    todo = [(np.arange(len(sample)), [], None)]
    while todo:
        rows, above, place = todo.pop()
        cut = split(rows, above) if len(rows) > max(leaf, 1) else None
        if cut is None:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number = len(low)
            normals.append(cut[0])
            offsets.append(cut[1])
            low.append(0)
            high.append(0)
            # planes far above are let go: as many as there are dimensions leave nothing
            above = [*above, cut[0]][-(sample.shape[1] // 2) or len(normals) :]
            todo.append((rows[cut[2]], above, (high, number)))
            todo.append((rows[~cut[2]], above, (low, number)))
        if place:
            place[0][place[1]] = number
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(normals).reshape(len(offsets), width), np.array(offsets), low, high, leaves)


def queue(forest: list[Tree], query: np.ndarray):
    """(tree, leaf) from the nearest cell on, over all trees through one priority queue."""
    waiting = [(0.0, number, 0 if tree.low else -1) for number, tree in enumerate(forest)]
    heapq.heapify(waiting)
    while waiting:
        away, number, node = heapq.heappop(waiting)
        tree = forest[number]
        while node >= 0:
            margin = float(tree.normals[node] @ query - tree.offsets[node])
            near, far = (tree.high, tree.low) if margin > 0 else (tree.low, tree.high)
            heapq.heappush(waiting, (away + margin * margin, number, far[node]))
            node = near[node]
        yield number, -1 - node


def visited(forest: list[Tree], sizes: list[np.ndarray], query: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """The leaves that a query meets until they hold ``budget`` rows."""
    found, rows = [], 0
    for number, leaf in queue(forest, query):
        found.append((number, leaf))
        rows += int(sizes[number][leaf])
        if rows >= budget:
            break
    return found


def search(
    queries: DataFrame, vectors: DataFrame, k: int = 20, recall: float = RECALL, trees: int = TREES,
    leaf: int = LEAF, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each row of ``queries``.

    Both have ``vec_id, embedding``; a query is no candidate of its own. Ties go to the smaller ``vec_id``.
    """
    queries, vectors = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for df in (queries, vectors))
    zero = F.forall("embedding", lambda x: x == 0)
    vectors = finite(vectors).where(~zero)
    n = vectors.agg(F.count("*")).first()[0]
    width = vectors.select(F.size("embedding").alias("w")).first()
    queries = finite(queries).where(~zero & (F.size("embedding") == (width["w"] if width else 0)))
    # equal vectors: only the k + 1 smallest ids can be among k neighbours
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    folded = vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    folded = written(folded.withColumn("vector_key", F.xxhash64("embedding")), "forest-vectors")
    asked = queries.groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    asked = written(asked.withColumn("vector_key", F.xxhash64("embedding")), "forest-queries")
    searched = asked.select("embedding").distinct().withColumn("query", F.monotonically_increasing_id())
    searched = written(searched, "forest-searched")

    forest = _forest(folded, n, trees, leaf)
    sizes = _sizes(folded, forest)
    budget = _budget(searched, folded, forest, sizes, k, recall)
    hits = _hits(searched, folded, forest, sizes, budget, k, cell_rows, query_rows)
    # the trees repeat each other's hits
    hits = hits.groupBy("query", "vec_id", "vector_key", "copy").agg(F.first("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "vector_key", "copy")
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    named = searched.withColumnRenamed("embedding", "vector")
    answers = asked.join(named, F.col("embedding") == F.col("vector")).select(
        F.col("vec_id").alias("query_id"), F.col("vector_key").alias("query_key"), "times", "query"
    )
    found = answers.join(hits, "query")
    # one copy of the query's own row goes, then the first k stay
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("vector_key") == F.col("query_key"))
    row = Window.partitionBy("query_id", "query_key")
    found = found.withColumn("own", F.when(own, F.col("place"))).withColumn("own", F.min("own").over(row))
    found = found.where(F.coalesce(F.col("place") != F.col("own"), F.lit(True)))
    rank = F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)
    found = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")


def _forest(folded: DataFrame, n: int, trees: int, leaf: int) -> list[Tree]:
    """Trees fitted on a bounded sample, each in a task of its own."""
    spark = folded.sparkSession
    width = folded.select(F.size("embedding").alias("w")).first()
    rows = max(1024, FIT_BYTES // (8 * (width["w"] if width else 1)))
    sample = chosen(folded, rows, n, "vec_id", "copy").select("vec_id", "copy", "embedding").toArrow()
    sample = sample.sort_by([("vec_id", "ascending"), ("copy", "ascending")])
    known = matrix(sample["embedding"])
    # as many rows of the sample as stand for `leaf` rows of the table
    share = max(2, round(leaf * len(known) / max(n, 1)))
    schema = "tree int, normals array<double>, offsets array<double>, low array<int>, high array<int>, leaves int"

    def fit(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                tree = fit_tree(known, share, SEED + number)
                row = [number, tree.normals.ravel().tolist(), tree.offsets.tolist(), tree.low, tree.high, tree.leaves]
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.Table.from_pylist([dict(zip(names, row))], fitted).to_batches()[0]

    numbers, reals = pa.list_(pa.int32()), pa.list_(pa.float64())
    fitted = pa.schema([("tree", pa.int32()), ("normals", reals), ("offsets", reals), ("low", numbers), ("high", numbers), ("leaves", pa.int32())])
    tasks = spark.range(0, trees, 1, trees)
    found = sorted(tasks.mapInArrow(fit, schema).collect(), key=lambda r: r.tree)
    size = known.shape[1]
    return [Tree(np.array(r.normals).reshape(len(r.offsets), size), np.array(r.offsets), r.low, r.high, r.leaves) for r in found]


def _sizes(folded: DataFrame, forest: list[Tree]) -> list[np.ndarray]:
    """Rows of each leaf; folded in each task, so as many rows as there are leaves come back from it."""

    def count(batches):
        sizes = [np.zeros(tree.leaves, np.int64) for tree in forest]
        for batch in batches:
            rows = matrix(batch.column(0))
            for tree, own in zip(forest, sizes):
                own += np.bincount(tree.place(rows), minlength=tree.leaves) if len(rows) else 0
        for number, own in enumerate(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), number, np.int32)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["tree", "leaf", "n"]
            )

    sizes = [np.zeros(tree.leaves, np.int64) for tree in forest]
    counted = folded.select("embedding").mapInArrow(count, "tree int, leaf int, n long")
    for row in counted.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[row.tree][row.leaf] = row.n
    return sizes


def _budget(searched: DataFrame, folded: DataFrame, forest: list[Tree], sizes: list[np.ndarray], k: int, recall: float) -> int:
    """Rows that a query must meet so that it meets the share ``recall`` of true neighbours."""
    everything = int(sum(own.sum() for own in sizes)) + 1
    if recall >= 1:
        return everything
    n = searched.count()
    some = chosen(searched, CALIBRATION, n, "embedding").select("query", "embedding").toArrow()
    asked = matrix(some["embedding"])
    if not len(asked):
        return everything

    def nearest(batches):
        for batch in batches:
            rows = matrix(batch.column(0))
            score = asked @ rows.T
            # the query itself is among the k + 1
            least = min(k + 1, len(rows))
            best = np.argpartition(-score, least - 1, axis=1)[:, :least] if len(rows) else np.zeros((len(asked), 0), int)
            query = np.repeat(np.arange(len(asked), dtype=np.int32), best.shape[1])
            taken = batch.column(0).take(pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score[query, best.ravel()]), taken], ["query", "score", "embedding"])

    kind = folded.schema["embedding"].dataType.simpleString()
    hits = folded.select("embedding").mapInArrow(nearest, f"query int, score double, embedding {kind}")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    true = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).toArrow()
    of, found = true["query"].to_numpy(), matrix(true["embedding"])
    leaves = [tree.place(found) for tree in forest]
    needed = np.full(len(of), everything)
    for q in np.unique(of):
        own = np.flatnonzero(of == q)
        wanted: dict[tuple[int, int], list[int]] = {}
        for row in own:
            for number, leaf in enumerate(leaves):
                wanted.setdefault((number, int(leaf[row])), []).append(row)
        rows, left = 0, len(own)
        for number, leaf in queue(forest, asked[q]):
            rows += int(sizes[number][leaf])
            for row in wanted.get((number, leaf), ()):
                if needed[row] == everything:
                    needed[row] = rows
                    left -= 1
            if not left:
                break
    # a query meets itself at once: that row is no neighbour
    itself = np.zeros(len(of), bool)
    itself[[np.flatnonzero(of == q)[0] for q in np.unique(of) if (found[of == q] == asked[q]).all(1).any()]] = True
    needed = np.sort(needed[~itself] if not itself.all() else needed)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def _hits(searched, folded, forest, sizes, budget, k, cell_rows, query_rows) -> DataFrame:
    """``query, vec_id, vector_key, copy, score``: per query and cell the best k + 1 rows of the leaves it visits."""
    spark = folded.sparkSession
    # cells of neighbouring leaves; a leaf that is a cell by itself may have parts
    cell_of, parts = [], []
    for own in sizes:
        ids = np.zeros(len(own), np.int64)
        held = None
        for leaf, size in enumerate(own.tolist()):
            if held is None or held + size > cell_rows:
                parts.append(1)
                held = 0
            held += size
            ids[leaf] = len(parts) - 1
            parts[-1] = max(1, -(-held // cell_rows))
        cell_of.append(ids)

    def place(batches):
        for batch in batches:
            rows = matrix(batch.column("embedding"))
            for tree, cells in zip(forest, cell_of):
                if len(rows):
                    leaf = tree.place(rows)
                    extra = [pa.array(cells[leaf].astype(np.int32)), pa.array(leaf.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "cell", "leaf"])

    def visit(batches):
        for batch in batches:
            rows, cells, lists, of = matrix(batch.column("embedding")), [], [], []
            for i, query in enumerate(rows):
                own: dict[int, list[int]] = {}
                for number, leaf in visited(forest, sizes, query, budget):
                    own.setdefault(int(cell_of[number][leaf]), []).append(leaf)
                for cell, leaves in own.items():
                    of.append(i)
                    cells.append(cell)
                    lists.append(leaves)
            taken = [c.take(pa.array(of, pa.int64())) for c in batch.columns]
            extra = [pa.array(cells, pa.int32()), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*taken, *extra], [*batch.schema.names, "cell", "leaves"])

    kind = folded.schema["embedding"].dataType.simpleString()
    held = folded.select("vec_id", "vector_key", "copy", "embedding")
    held = held.mapInArrow(place, f"vec_id long, vector_key long, copy int, embedding {kind}, cell int, leaf int")
    asked = searched.select("query", "embedding").mapInArrow(visit, f"query long, embedding {kind}, cell int, leaves array<int>")
    asked = written(asked, "forest-visits")
    # as many rows as there are cells
    many = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    cut = spark.createDataFrame([(c, parts[c], -(-m // query_rows)) for c, m in many.items()], "cell int, vector_parts int, query_parts int")

    def part(of: int, *keys: str):
        return F.pmod(F.xxhash64(*keys), F.col(of)).cast("int")

    def each(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    group = ["cell", "vector_part", "query_part"]
    held = held.join(F.broadcast(cut), "cell").withColumn("vector_part", part("vector_parts", "vec_id", "copy"))
    held = held.select("cell", "vector_part", each("query_parts").alias("query_part"), "leaf", "vec_id", "vector_key", "copy", "embedding")
    asked = asked.join(F.broadcast(cut), "cell").withColumn("query_part", part("query_parts", "query"))
    asked = asked.select("cell", each("vector_parts").alias("vector_part"), "query_part", "query", "leaves", "embedding")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        return _ranked(left, right, k + 1)

    schema = "query long, vec_id long, vector_key long, copy int, score double"
    return asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(rank, schema)


def _ranked(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of each query among the leaves it visits."""
    held = held.sort_by("leaf")
    leaf, rows, queries = held["leaf"].to_numpy(), matrix(held["embedding"]), matrix(asked["embedding"])
    lists = asked["leaves"].combine_chunks()
    flat = lists.flatten().to_numpy()
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    best: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in _runs(leaf):
        who = of[np.searchsorted(flat, leaf[a]) : np.searchsorted(flat, leaf[a], side="right")]
        step = max(1, (1 << 22) // (b - a))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            best.append(_leaders(queries, rows, some, np.arange(a, b), k))
    if best:
        q, r = (np.concatenate(x) for x in zip(*best))
        q, r, score = _cut(queries, rows, held["vec_id"].to_numpy(), q, r, k)
    else:
        q, r, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    taken = held.select(["vec_id", "vector_key", "copy"]).take(pa.array(r))
    return pa.Table.from_arrays([asked["query"].take(pa.array(q)), *taken.columns, pa.array(score)], ["query", *taken.column_names, "score"])


def _runs(values: np.ndarray):
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *cuts.tolist()] if len(values) else [], [*cuts.tolist(), len(values)])


def _leaders(queries, rows, who, span, k):
    """Pairs (query, row) whose products may be among a query's ``k`` largest; equal ones and a rounding's width more."""
    score = queries[who] @ rows[span].T
    if len(span) <= k:
        return np.repeat(who, len(span)), np.tile(span, len(who))
    least = np.partition(score, len(span) - k, axis=1)[:, len(span) - k]
    slack = 1e-13 * np.linalg.norm(queries[who], axis=1) * np.linalg.norm(rows[span], axis=1).max()
    i, j = np.nonzero(score >= (least - slack)[:, None])
    return who[i], span[j]


def _cut(queries, rows, ids, q, r, k):
    """The pairs' products, each summed in the order of the elements, and the best ``k`` of every query."""
    score = np.empty(len(q))
    step = max(1, (1 << 22) // max(1, rows.shape[1]))
    for at in range(0, len(q), step):
        some = slice(at, at + step)
        score[some] = (queries[q[some]] * rows[r[some]]).sum(1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], r[kept], score[kept]


def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each row whose id is divisible by 20."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)
