"""Hard negatives by an R-tree over integer vectors, packed by sort-tile-recursive.

Rows are cut into shards of about ``SHARD_ROWS``: by label, then by slices along the axes of greatest spread, the
cuts taken from a bounded sample (``FIT_BYTES``). In a shard's task the rows are packed the same way into pages of ``PAGE``
rows, and ``FANOUT`` neighbouring boxes make a box of the next level. A box knows the least and largest value
of every coordinate, of the label and the least id in it. With an anchor a, coordinate i adds between
min(a_i * least_i, a_i * largest_i) and max(...) to the inner product, so a box has an interval of
scores. A search takes boxes by the top of their interval from one queue and leaves out those

* of the wrong label,
* whose interval lies outside the score window,
* strictly below the k-th score found so far, or as high but with larger ids only.

Nothing is approximate: a shard is left out by the same rules, with the k-th score among the sample's
rows as a bound (they are rows of the table). Vectors without structure have wide
boxes; then most are visited, in blocks of one shard and ``QUERY_ROWS`` anchors.

Scale: of rows equal in label and vector only the first few by id can be answers, the others are folded before, partly
ahead of the shuffle; equal anchors are searched once. Each search shuffles rows once, in groups of bounded
size, and what is broadcast or sent to the driver is the sample and one box per shard.

Defined results: rows whose id, label or vector is NULL, or whose vector is empty, of another length than the most frequent
one or holds a NULL, NaN or infinite element take no part, nor do those whose integers' squares add up to 2**62 or more (a score might
not fit a long). Repeated rows are rows of their own: each is the others' candidate, and each gives its own answer.
An anchor without positives, or a positive without negatives in its window, gives no rows.
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

FIT_BYTES = 8 << 20
SHARD_ROWS = 1 << 15
QUERY_ROWS = 1 << 12
PAGE = 128
FANOUT = 16
#: Scores up to here are exact as 64-bit floats.
EXACT = 2.0**53
LABELS = 10


# ---- packing -----------------------------------------------------------------

def axes_of(rows: np.ndarray, tiles: int) -> list[int]:
    """The axes to slice along: those of greatest spread, about four slices each."""
    many = min(rows.shape[1], max(1, -(-max(tiles - 1, 1).bit_length() // 2)))
    return np.argsort(-rows.astype(np.float64).std(0), kind="stable")[:many].tolist() if len(rows) else []


def tiled(rows: np.ndarray, members: np.ndarray, axes: list[int], size: int) -> list[np.ndarray]:
    """``members`` in tiles of ``size`` rows at most: sorted and sliced along one axis after the other."""
    tiles = -(-len(members) // size)
    if tiles <= 1:
        return [members] if len(members) else []
    slices = max(2, round(tiles ** (1 / len(axes)))) if len(axes) > 1 else tiles
    members = members[np.argsort(rows[members, axes[0]], kind="stable")]
    each = -(-tiles // slices) * size
    found = []
    for at in range(0, len(members), each):
        piece = members[at : at + each]
        found += tiled(rows, piece, axes[1:] or axes, size) if len(piece) > size else [piece]
    return found


@dataclass
class RTree:
    """Pages of rows, and boxes over them level by level; ``levels[0]`` are the pages' boxes."""

    rows: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    begins: np.ndarray
    levels: list[dict[str, np.ndarray]]


def pack(rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> RTree:
    """An R-tree whose pages hold one label each, where a label fills a page."""
    order = np.lexsort((ids, labels))
    names, first = np.unique(labels[order], return_index=True)
    pages, small = [], []
    axes = axes_of(rows, -(-len(rows) // page))
    for a, b in zip(first, [*first[1:], len(order)]):
        if b - a >= page:
            pages += tiled(rows, order[a:b], axes, page)
        else:
            small.append(order[a:b])
    small = np.concatenate(small) if small else order[:0]
    pages += [small[at : at + page] for at in range(0, len(small), page)]
    order = np.concatenate(pages) if pages else order
    begins = np.cumsum([0, *map(len, pages)])
    rows, labels, ids = rows[order], labels[order], ids[order]
    at = begins[:-1]
    boxes = _boxes(rows, rows, labels, labels, ids, at)
    levels = [boxes]
    while len(levels[-1]["id"]) > fanout:
        below = levels[-1]
        at = np.arange(0, len(below["id"]), fanout)
        levels.append(_boxes(below["low"], below["high"], below["label_low"], below["label_high"], below["id"], at))
    return RTree(rows, labels, ids, begins, levels)


def _boxes(low, high, label_low, label_high, ids, at) -> dict[str, np.ndarray]:
    return {
        "low": np.minimum.reduceat(low, at, axis=0) if len(at) else low[:0],
        "high": np.maximum.reduceat(high, at, axis=0) if len(at) else high[:0],
        "label_low": np.minimum.reduceat(label_low, at) if len(at) else label_low[:0],
        "label_high": np.maximum.reduceat(label_high, at) if len(at) else label_high[:0],
        "id": np.minimum.reduceat(ids, at) if len(at) else ids[:0],
    }


def intervals(low: np.ndarray, high: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that a row of each box can have with ``anchor``; as floats, wide enough."""
    plus, minus = np.maximum(anchor, 0).astype(np.float64), np.minimum(anchor, 0).astype(np.float64)
    least, most = low @ plus + high @ minus, high @ plus + low @ minus
    size = np.maximum(np.abs(low), np.abs(high)) @ np.abs(anchor).astype(np.float64)
    slack = np.where(size < EXACT, 0.0, size * 1e-12)
    return least - slack, most + slack


def right_label(box: dict[str, np.ndarray], label: int, same: bool) -> np.ndarray:
    """True where a box may hold rows of the label (``same``), or of another one."""
    if same:
        return (box["label_low"] <= label) & (label <= box["label_high"])
    return (box["label_low"] != label) | (box["label_high"] != label)


def best_first(
    tree: RTree, anchor: np.ndarray, label: int, same: bool, k: int, low: float = -np.inf, high: float = np.inf, floor: float = -np.inf,
    scores: dict | None = None,
) -> list[tuple[int, int]]:
    """The first ``k`` (score, id) of the rows of the label (``same``) or of the others, scores from ``low`` to ``high``.

    Rows below ``floor`` may be left out. ``scores`` keeps the pages' scores for further windows of one anchor.
    """
    scores = {} if scores is None else scores
    worst: list[tuple[int, int]] = []  # the k best so far, as (score, -id), the last one first
    waiting: list[tuple[float, int, int, int]] = []

    def offer(level: int, begin: int, end: int) -> None:
        box = {name: values[begin:end] for name, values in tree.levels[level].items()}
        least, most = intervals(box["low"], box["high"], anchor)
        bar = max(floor, worst[0][0]) if len(worst) == k else floor
        fits = right_label(box, label, same) & _reached(least, most, low, high, bar)
        # not below `high` where floats are too coarse for it
        top = np.minimum(most, high if abs(high) < EXACT else np.inf)
        for i in np.flatnonzero(fits).tolist():
            heapq.heappush(waiting, (-float(top[i]), int(box["id"][i]), level, begin + i))

    if len(tree.rows):
        offer(len(tree.levels) - 1, 0, len(tree.levels[-1]["id"]))
    while waiting:
        top, least_id, level, node = heapq.heappop(waiting)
        if len(worst) == k and -top < worst[0][0]:
            break
        if len(worst) == k and -top == worst[0][0] and least_id > -worst[0][1]:
            continue
        if level:
            offer(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(tree.levels[level - 1]["id"])))
            continue
        a, b = tree.begins[node], tree.begins[node + 1]
        if node not in scores:
            scores[node] = _products(tree.rows[a:b], anchor)
        score, ids, labels = scores[node], tree.ids[a:b], tree.labels[a:b]
        fits = np.flatnonzero(((labels == label) == same) & (score >= low) & (score <= high) & (score >= floor))
        if len(fits) > k:
            fits = fits[np.lexsort((ids[fits], -score[fits]))[:k]]
        for i in fits.tolist():
            pair = int(score[i]), -int(ids[i])
            if len(worst) < k:
                heapq.heappush(worst, pair)
            elif pair > worst[0]:
                heapq.heapreplace(worst, pair)
    return [(score, -number) for score, number in sorted(worst, reverse=True)]


def _products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products as integers; sums of 64-bit integers are right even if a partial sum runs over."""
    return rows @ anchor


# ---- Spark -------------------------------------------------------------------

def mine(
    anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both frames have ``vec_id, label, vector`` with whole numbers; anchors are rows of ``rows``. ``share`` (a, b) asks for
    a * positive_score <= b * negative_score <= b * positive_score.
    """
    kept = max(positives + 1, negatives)
    copies = Window.partitionBy("label", "vector").orderBy("vec_id")
    folded = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= kept).drop("copy")
    folded = written(folded, "mine-rows")
    asked = anchors.groupBy("vec_id", "label", "vector").agg(F.count("*").alias("times"))
    asked = written(asked, "mine-anchors")
    searched = asked.select("label", "vector").distinct().withColumn("query", F.monotonically_increasing_id())
    searched = written(searched, "mine-searched")
    shards = _Shards(folded, shard_rows)

    none = F.array().cast("array<long>")
    near = shards.search(searched.withColumn("windows", none), positives + 1, share, query_rows)
    # rows equal to the anchor's: the own one is left out
    like = searched.withColumnsRenamed({"label": "own_label", "vector": "own_vector"})
    same = (F.col("label") == F.col("own_label")) & (F.col("vector") == F.col("own_vector"))
    found = asked.join(like, same).select(F.col("vec_id").alias("anchor_id"), "times", "query").join(near, "query")
    own = F.when((F.col("vec_id") == F.col("anchor_id")) & F.col("equal"), F.col("place"))
    row = Window.partitionBy("anchor_id", "query")
    found = found.withColumn("own", F.min(own).over(row)).where(F.coalesce(F.col("place") != F.col("own"), F.lit(True)))
    rank = F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)
    found = found.withColumn("positive_rank", rank).where(F.col("positive_rank") <= positives)
    found = found.select("anchor_id", "times", "query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = written(found, "mine-positives")

    windows = found.groupBy("query").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    far = shards.search(searched.join(windows, "query"), negatives, share, query_rows)
    far = far.select("query", F.col("window").alias("positive_score"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    again = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return found.join(far, ["query", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", again
    ).drop("col")


class _Shards:
    """The rows of a search by shard, and what every task knows of the shards."""

    def __init__(self, rows: DataFrame, shard_rows: int):
        self.spark = rows.sparkSession
        n = rows.count()
        width = rows.select(F.size("vector").alias("w")).first()
        wanted = max(1024, FIT_BYTES // (16 * (width["w"] if width else 1)))
        sample = chosen(rows, wanted, n, "vec_id", "label", "vector").toArrow()
        sample = sample.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        self.sample, self.sample_labels = matrix(sample["vector"], np.int64), sample["label"].to_numpy()
        self.cuts = _Cuts(self.sample, self.sample_labels, max(1, -(-n // shard_rows)))
        cuts = self.cuts
        schema = "vec_id long, label long, vector array<int>, shard int"

        def place(batches):
            for batch in batches:
                shard = cuts.place(matrix(batch.column("vector"), np.int64), batch.column("label").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

        self.rows = rows.select("vec_id", "label", "vector").mapInArrow(place, schema)
        self._measure(shard_rows)

    def _measure(self, shard_rows: int) -> None:
        """Box and number of rows of each shard; folded in each task, then over tasks."""
        schema = "shard int, n long, low array<int>, high array<int>, label_low long, label_high long, id long"

        def fold(batches):
            tables = [pa.Table.from_batches([b]) for b in batches]
            yield from _shard_boxes(tables, False)

        def merge(group: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(_shard_boxes([group], True)))

        boxes = self.rows.mapInArrow(fold, schema).groupBy("shard").applyInArrow(merge, schema)
        found = sorted(boxes.collect(), key=lambda r: r.shard)
        self.names = np.array([r.shard for r in found], np.int64)
        self.box = {
            "low": np.array([r.low for r in found], np.int64).reshape(len(found), self.sample.shape[1]),
            "high": np.array([r.high for r in found], np.int64).reshape(len(found), self.sample.shape[1]),
            **{c: np.array([r[c] for r in found], np.int64) for c in ("label_low", "label_high", "id")},
        }
        # a shard that many rows with the same coordinates fall in is cut by a hash of the id
        self.parts = {r.shard: -(-r.n // (2 * shard_rows)) for r in found}

    def search(self, searched: DataFrame, k: int, share: tuple[int, int], query_rows: int) -> DataFrame:
        """``query, window, place, vec_id, score, equal`` for ``searched(query, label, vector, windows)``.

        Without windows: the first ``k`` rows of the same label. Else per window p: of other labels, from share * p to p.
        """
        sample, sample_labels, box, names = self.sample, self.sample_labels, self.box, self.names
        fields = "query long, label long, vector array<int>, windows array<long>"

        def visit(batches):
            for batch in batches:
                of, shards, floors = [], [], []
                vectors, labels = matrix(batch.column("vector"), np.int64), batch.column("label").to_numpy()
                for i, (anchor, label, asked) in enumerate(zip(vectors, labels.tolist(), batch.column("windows").to_pylist())):
                    score = sample @ anchor if len(sample) else np.zeros(0, np.int64)
                    same = sample_labels == label
                    least, most = intervals(box["low"], box["high"], anchor)
                    bounds, reach = [], np.zeros(len(names), bool)
                    for low, high in _windows(asked, share):
                        fits = score[same if not asked else ~same & (score >= low) & (score <= high)]
                        floor = int(np.partition(fits, len(fits) - k)[len(fits) - k]) if len(fits) >= k else None
                        bounds.append(floor)
                        reach |= _reached(least, most, low, high, floor)
                    for shard in names[reach & right_label(box, label, not asked)].tolist():
                        of.append(i)
                        shards.append(shard)
                        floors.append(bounds)
                taken = [c.take(pa.array(of, pa.int64())) for c in batch.columns]
                extra = [pa.array(shards, pa.int32()), pa.array(floors, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*taken, *extra], [*batch.schema.names, "shard", "floors"])

        visits = searched.select("query", "label", "vector", "windows").mapInArrow(visit, f"{fields}, shard int, floors array<long>")
        visits = written(visits, "mine-visits")
        # as many rows as there are shards
        many = {r.shard: r["count"] for r in visits.groupBy("shard").count().collect()}
        cut = [(s, self.parts[s], -(-m // query_rows)) for s, m in many.items()]
        cut = self.spark.createDataFrame(cut, "shard int, row_parts int, query_parts int")

        def part(of: str, key: str):
            return F.pmod(F.xxhash64(key), F.col(of)).cast("int")

        def each(of: str):
            return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

        group = ["shard", "row_part", "query_part"]
        rows = self.rows.join(F.broadcast(cut), "shard").withColumn("row_part", part("row_parts", "vec_id"))
        rows = rows.select("shard", "row_part", each("query_parts").alias("query_part"), "vec_id", "label", "vector")
        asked = visits.join(F.broadcast(cut), "shard").withColumn("query_part", part("query_parts", "query"))
        asked = asked.select("shard", each("row_parts").alias("row_part"), "query_part", "query", "label", "vector", "windows", "floors")

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            return _answers(left, right, k, share)

        schema = "query long, window long, vec_id long, score long, equal boolean"
        hits = asked.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(answer, schema)
        best = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id", F.desc("equal"))
        return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _reached(least: np.ndarray, most: np.ndarray, low: float, high: float, floor: int | None) -> np.ndarray:
    """Boxes whose interval meets the window and is not strictly below ``floor``; ends beyond EXACT are widened."""
    wide = lambda x, way: x if abs(x) < EXACT else float(np.nextafter(float(x), way))
    low, high = wide(low, -np.inf), wide(high, np.inf)
    floor = -np.inf if floor is None else wide(floor, -np.inf)
    return (most >= low) & (least <= high) & (np.minimum(most, high) >= floor)


class _Cuts:
    """Shards by slices of labels, then of the axes of greatest spread; cut at quantiles of a sample."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, shards: int):
        self.shards = 0
        self.axes = axes_of(sample, shards)
        slabs = min(shards, len(np.unique(labels)) or 1)
        self.label_cuts = _quantiles(labels, slabs)
        slab = np.searchsorted(self.label_cuts, labels, side="right")
        self.slabs = [self._slice(sample[slab == s], -(-shards // slabs), self.axes) for s in range(len(self.label_cuts) + 1)]

    def _slice(self, sample: np.ndarray, tiles: int, axes: list[int]):
        """A shard's number, or (axis, cuts, what is between the cuts)."""
        if tiles <= 1 or not axes:
            self.shards += 1
            return self.shards - 1
        slices = max(2, round(tiles ** (1 / len(axes)))) if len(axes) > 1 else tiles
        cuts = _quantiles(sample[:, axes[0]], slices)
        side = np.searchsorted(cuts, sample[:, axes[0]], side="right")
        below = [self._slice(sample[side == s], -(-tiles // slices), axes[1:]) for s in range(len(cuts) + 1)]
        return axes[0], cuts, below

    def place(self, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)

        def walk(node, members: np.ndarray) -> None:
            if isinstance(node, int):
                out[members] = node
                return
            axis, cuts, below = node
            side = np.searchsorted(cuts, rows[members, axis], side="right")
            for s, child in enumerate(below):
                walk(child, members[side == s])

        slab = np.searchsorted(self.label_cuts, labels, side="right")
        for s, node in enumerate(self.slabs):
            walk(node, np.flatnonzero(slab == s))
        return out


def _quantiles(values: np.ndarray, slices: int) -> np.ndarray:
    """Values at which slices of about equal numbers begin."""
    if not len(values) or slices <= 1:
        return np.zeros(0, np.int64)
    values = np.sort(values)
    return np.unique(values[[len(values) * s // slices for s in range(1, slices)]])


def _shard_boxes(tables: list[pa.Table], merged: bool):
    """One row per shard over the tables, whose rows are vectors or (``merged``) boxes."""
    held: dict[int, list] = {}
    for table in tables:
        shard = table["shard"].to_numpy()
        order = np.argsort(shard, kind="stable")
        names, at = np.unique(shard[order], return_index=True)
        if not len(order):
            continue
        low = matrix(table["low" if merged else "vector"], np.int64)[order]
        high = matrix(table["high"], np.int64)[order] if merged else low
        label_low = table["label_low" if merged else "label"].to_numpy()[order]
        label_high = table["label_high"].to_numpy()[order] if merged else label_low
        ids = table["id" if merged else "vec_id"].to_numpy()[order]
        n = np.add.reduceat(table["n"].to_numpy()[order] if merged else np.ones(len(order), np.int64), at)
        box = _boxes(low, high, label_low, label_high, ids, at)
        for i, name in enumerate(names.tolist()):
            new = [int(n[i]), box["low"][i], box["high"][i], int(box["label_low"][i]), int(box["label_high"][i]), int(box["id"][i])]
            if old := held.get(name):
                new = [
                    old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]),
                    min(old[3], new[3]), max(old[4], new[4]), min(old[5], new[5]),
                ]
            held[name] = new
    numbers = pa.list_(pa.int32())
    kinds = [pa.int32(), pa.int64(), numbers, numbers, pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*[[name, v[0], v[1].tolist(), v[2].tolist(), *v[3:]] for name, v in held.items()])) or [[]] * 7
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
    yield pa.RecordBatch.from_arrays(arrays, ["shard", "n", "low", "high", "label_low", "label_high", "id"])


def _windows(asked: list[int], share: tuple[int, int]) -> list[tuple[float, float]]:
    """(low, high) of each positive score; without any, everything."""
    return [(-(-share[0] * p // share[1]), p) for p in asked] if asked else [(-np.inf, np.inf)]


def _answers(asked: pa.Table, held: pa.Table, k: int, share: tuple[int, int]) -> pa.Table:
    out: list[tuple] = []
    if len(held):
        tree = pack(matrix(held["vector"], np.int64), held["label"].to_numpy(), held["vec_id"].to_numpy())
        vectors, labels = matrix(asked["vector"], np.int64), asked["label"].to_pylist()
        for query, anchor, label, windows, floors in zip(asked["query"].to_pylist(), vectors, labels, asked["windows"].to_pylist(), asked["floors"].to_pylist()):
            scores: dict = {}
            own = int(anchor @ anchor)
            for window, (low, high), floor in zip(windows or [0], _windows(windows, share), floors):
                found = best_first(tree, anchor, label, not windows, k, low, high, -np.inf if floor is None else floor, scores)
                equal = _equal_ids(tree, scores, anchor, label, own) if not windows and any(s == own for s, _ in found) else ()
                out += [(query, window, number, score, score == own and number in equal) for score, number in found]
    kinds = [pa.int64()] * 4 + [pa.bool_()]
    columns = list(zip(*out)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "window", "vec_id", "score", "equal"])


def _equal_ids(tree: RTree, scores: dict, anchor: np.ndarray, label: int, own: int) -> set[int]:
    """Ids of the rows met that are equal to the anchor in label and vector."""
    found = set()
    for node, score in scores.items():
        a, b = tree.begins[node], tree.begins[node + 1]
        for i in np.flatnonzero((score == own) & (tree.labels[a:b] == label)).tolist():
            if (tree.rows[a + i] == anchor).all():
                found.add(int(tree.ids[a + i]))
    return found


def whole(df: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: each element x as floor(scale * x); rows that take no part are left out."""
    held = finite(df.where("label IS NOT NULL"))
    scaled = held.withColumn("vector", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return scaled.where(square < 2.0**62).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("vector", lambda x: x.cast("int")).alias("vector"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hard negatives of each positive of the rows whose id is divisible by 100."""
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = written(whole(rows.withColumn("label", moved)), "mine-whole")
    return mine(rows.where(F.col("vec_id") % 100 == 0), rows)


OP12_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), named AS (
  SELECT *, row_number() OVER (ORDER BY vec_id) AS row FROM sound
), coordinates AS (
  SELECT row, vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM named
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS other_id, a.label = b.label AS same,
         sum(a.x * b.x)::BIGINT AS score
  FROM coordinates a JOIN coordinates b ON a.i = b.i
  WHERE a.vec_id % 100 = 0 AND a.row <> b.row
  GROUP BY ALL
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id)::INT AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n
  ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
