"""Approximate nearest neighbours by random-projection hash families.

A family is ``bits`` random planes through the middle of the data; a vector's bucket in it is the side of each plane
it lies on. A query visits, over all families, the buckets it lies nearest to: its own ones first, then those across
one or more planes, in the order of the squared distances to the planes crossed. Candidates meet queries in a join
on (family, bucket), and each bucket ranks its own by exact distance, so what comes out are true distances of
most, not all, of the nearest vectors. :func:`neighbours.nearest` is the exact way.

Buckets travel in groups of as many vectors as a task holds. A query goes out once per group that holds a bucket it
visits, with a bit for each of the group's buckets: vectors without structure, of which it visits thousands, cost
comparisons, not copies of rows, and its order of buckets is made once, not in every task.

How many buckets a query visits is measured: the true neighbours of ``CALIBRATION`` queries at most are found by
comparing them with all vectors, and the queries' own order of buckets says how many visits meet the share ``recall``
of them. Vectors in clear groups need a few, vectors without structure a large part of all buckets.

Scale: ``bits`` grows with the logarithm of the number of vectors, so buckets do not grow until ``MOST_BITS``.
Vectors are shuffled once per family. Of equal vectors only the first ``k`` go into the join. A group of more
vectors or queries than a task holds is cut into parts on both sides; ``block`` rows are compared at once. What each task knows are the planes and the buckets'
sizes, 2 ** ``MOST_BITS`` numbers per family at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_matrix, top_k, top_k_in_groups
from ..sources.work import written
from . import neighbours

FAMILIES = 4
#: Vectors of a bucket that ``bits`` aims at.
BUCKET = 128
MOST_BITS = 16
CALIBRATION = 128
RECALL = 0.95
#: Rows that the planes' offsets are taken from, at most.
SAMPLE = 4096
SEED = 5


class Families:
    """The planes of all families, and what lies in their buckets."""

    def __init__(self, width: int, bits: int, families: int, sample: np.ndarray, seed: int = SEED):
        draw = np.random.default_rng(seed)
        # planes of one family at right angles, as far as there are dimensions
        made = [np.linalg.qr(draw.normal(size=(width, width)))[0] for _ in range(families * -(-bits // max(width, 1)))]
        columns = np.concatenate(made, axis=1) if made else np.zeros((width, 0))
        per = -(-bits // max(width, 1)) * width
        self.normals = [columns[:, f * per : f * per + bits] for f in range(families)]
        self.offsets = [np.median(sample @ n, axis=0) if len(sample) else np.zeros(bits) for n in self.normals]
        self.bits = bits
        self.sizes: list[dict[int, int]] = [{} for _ in range(families)]

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Bucket of each row in each family, as bits."""
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return np.stack([((rows @ n > o) * weights).sum(1) for n, o in zip(self.normals, self.offsets)], 1)

    def visited(self, queries: np.ndarray, many: int) -> Iterator[tuple[int, np.ndarray]]:
        """For some queries at a time, where they begin and which buckets are among the first ``many`` that :meth:`visits` gives.

        Columns follow :meth:`buckets`. A bucket's distance is the sum over the planes on whose other side it lies.
        """
        family, bucket = self.buckets()
        sides = (bucket[:, None] >> np.arange(self.bits) & 1).astype(np.float64)
        step = max(1, min(1024, (1 << 21) // max(1, len(family))))
        for start in range(0, len(queries), step):
            block = queries[start : start + step]
            if many >= len(family):
                yield start, np.ones((len(block), len(family)), bool)
                continue
            away = np.empty((len(block), len(family)))
            for f, (normal, offset) in enumerate(zip(self.normals, self.offsets)):
                margin = block @ normal - offset
                own, price, at = margin > 0, margin**2, slice(*np.searchsorted(family, [f, f + 1]))
                away[:, at] = (price * own).sum(1)[:, None] + np.where(own, -price, price) @ sides[at].T
                # its own bucket costs nothing, whatever the sums round to
                code = (own << np.arange(self.bits)).sum(1)
                place = np.minimum(np.searchsorted(bucket[at], code), max(at.stop - at.start - 1, 0))
                row = np.flatnonzero(bucket[at][place] == code) if at.stop > at.start else np.zeros(0, int)
                away[row, at.start + place[row]] = 0.0
            last = np.partition(away, many - 1, axis=1)[:, many - 1 : many]
            near = away <= last
            # ties go to the smaller family, then bucket
            for row in np.flatnonzero(near.sum(1) > many):
                ties = np.flatnonzero(away[row] == last[row])
                near[row, ties[many - int((away[row] < last[row]).sum()) :]] = False
            yield start, near

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Family and number of every bucket that holds vectors, in order."""
        listed = [(f, b) for f, own in enumerate(self.sizes) for b in sorted(own)]
        family, bucket = np.array(listed, dtype=np.int64).reshape(-1, 2).T
        return family, bucket

    def visits(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(family, bucket) from the nearest on, buckets without vectors left out.

        Every set of planes to cross is met once: a set is followed by the one whose last plane is moved on to the next
        nearest, and by the one that crosses that plane as well.
        """
        own, order, cost = [], [], []
        for normal, offset in zip(self.normals, self.offsets):
            margin = query @ normal - offset
            by = np.argsort(margin**2, kind="stable")
            own.append(int(((margin > 0) * (1 << np.arange(self.bits, dtype=np.int64))).sum()))
            order.append(by)
            cost.append((margin**2)[by])
        waiting: list[tuple[float, int, int, int]] = [(0.0, f, own[f], -1) for f in range(len(own))]
        heapq.heapify(waiting)
        while waiting:
            away, family, bucket, last = heapq.heappop(waiting)
            if bucket in self.sizes[family]:
                yield family, bucket
            if last + 1 < self.bits:
                plane, price = int(order[family][last + 1]), cost[family][last + 1]
                heapq.heappush(waiting, (away + price, family, bucket ^ (1 << plane), last + 1))
                if last >= 0:
                    before, paid = int(order[family][last]), cost[family][last]
                    heapq.heappush(waiting, (away + price - paid, family, bucket ^ (1 << plane) ^ (1 << before), last + 1))


def nearest_approximate(
    queries: DataFrame, vectors: DataFrame, k: int = 3, recall: float = RECALL, families: int = FAMILIES,
    bucket: int = BUCKET, block: int | None = None,
) -> DataFrame:
    """``query_id, vec_id, rank, distance``: about the share ``recall`` of the ``k`` nearest, with exact distances.

    ``queries`` has ``query_id, embedding`` and ``vectors`` has ``vec_id, embedding``; ids are unique. Rows without a
    usable vector are passed over, another length is an error, ties go to the smaller ``vec_id``, as in
    :func:`neighbours.nearest`. ``recall=1.0`` visits every bucket.
    """
    queries, vectors = neighbours._prepared(queries, "query_id"), neighbours._prepared(vectors, "vec_id")
    width = neighbours._width(vectors) or neighbours._width(queries) or 1
    queries, vectors = neighbours._equally_long(queries, width), neighbours._equally_long(vectors, width)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    held = vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k).drop("copy")
    held = written(held, "approximate-vectors")
    n = held.count()
    made = _families(held, n, width, families, bucket)
    many = _visits_needed(queries, held, made, k, recall)
    return neighbours._ranked(_hits(queries, held, made, many, width, k, block), k)


def _families(held: DataFrame, n: int, width: int, families: int, bucket: int) -> Families:
    scale = 1 << 40
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(scale)) < int(scale * min(1.0, SAMPLE / max(n, 1)))
    rows = held.where(chosen).select("vec_id", "embedding").toArrow().sort_by("vec_id")
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / bucket)), 1, MOST_BITS))
    made = Families(width, bits, families, as_matrix(rows["embedding"]))

    def count(batches):
        sizes = [np.zeros(1 << made.bits, np.int64) for _ in range(families)]
        for batch in batches:
            if batch.num_rows:
                for own, codes in zip(sizes, made.codes(as_matrix(batch.column(0))).T):
                    own += np.bincount(codes, minlength=len(own))
        for family, own in enumerate(sizes):
            full = np.flatnonzero(own)
            columns = [pa.array(np.full(len(full), family, np.int32)), pa.array(full), pa.array(own[full])]
            yield pa.RecordBatch.from_arrays(columns, ["family", "bucket", "n"])

    counted = held.select("embedding").mapInArrow(count, "family int, bucket long, n long")
    for row in counted.groupBy("family", "bucket").agg(F.sum("n").alias("n")).collect():
        made.sizes[row.family][row.bucket] = row.n
    return made


def _visits_needed(queries: DataFrame, held: DataFrame, made: Families, k: int, recall: float) -> int:
    """Buckets that a query must visit to meet the share ``recall`` of true neighbours."""
    everything = sum(map(len, made.sizes))
    n = queries.count()
    scale = 1 << 40
    chosen = F.pmod(F.xxhash64("query_id", F.lit(SEED)), F.lit(scale)) < int(scale * min(1.0, CALIBRATION / max(n, 1)))
    few = neighbours._few(queries.where(chosen), 8 * CALIBRATION)
    if recall >= 1 or few is None or not len(few[0]) or not everything:
        return everything
    hits = neighbours._queries_to_vectors(queries, held, few, k)
    # k rows per query of the sample
    true = neighbours._ranked(hits, k).join(held, "vec_id").select("query_id", "embedding").toArrow()
    codes = made.codes(as_matrix(true["embedding"]))
    of = true["query_id"].to_pylist()
    asked = dict(zip(few[0], few[1]))
    wanted: dict = {}
    for row, query_id in enumerate(of):
        wanted.setdefault(query_id, []).append(row)
    needed = []
    for query_id, rows in wanted.items():
        left = set(rows)
        for visits, (family, code) in enumerate(made.visits(asked[query_id]), 1):
            met = {row for row in left if codes[row, family] == code}
            needed += [visits] * len(met)
            left -= met
            if not left:
                break
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]


def _hits(queries, held, made: Families, many: int, width: int, k: int, block: int | None) -> DataFrame:
    spark = held.sparkSession
    family, bucket = made.buckets()
    size = np.array([made.sizes[f][b] for f, b in zip(family, bucket)], dtype=np.int64)
    # by family, so that a place is found by its bucket
    starts = np.searchsorted(family, np.arange(len(made.sizes) + 1))

    # ``place`` numbers the buckets that hold vectors
    def place(batches):
        for batch in batches:
            if batch.num_rows:
                for f, codes in enumerate(made.codes(as_matrix(batch.column(1))).T):
                    own = starts[f] + np.searchsorted(bucket[starts[f] : starts[f + 1]], codes)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "place"])

    def count(batches):
        total = np.zeros(len(family) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            if batch.num_rows:
                for _, near in made.visited(as_matrix(batch.column(0)), many):
                    total[:-1] += near.sum(0)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["place", "n"])

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (held, "vec_id"))}
    visits = np.zeros(len(family) + 1, np.int64)
    # one row per bucket at most; buckets are bounded by MOST_BITS
    for row in queries.select("embedding").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        visits[row.place] = row.n
    group, parts = neighbours._grouped(np.arange(len(family)), family, size, visits, width, spark.sparkContext.defaultParallelism)
    of_groups = [np.flatnonzero(group == g) for g in range(len(parts))]

    def visit(batches):
        for batch in batches:
            rows = as_matrix(batch.column(1)) if batch.num_rows else np.zeros((0, width))
            for start, near in made.visited(rows, many):
                for g, own in enumerate(of_groups):
                    met = near[:, own]
                    row = np.flatnonzero(met.any(1))
                    bits = [x.tobytes() for x in np.packbits(met[row], axis=1)]
                    taken = [c.take(pa.array(row + start)) for c in batch.columns]
                    taken += [pa.array(np.full(len(row), g, np.int32)), pa.array(bits, pa.binary())]
                    yield pa.RecordBatch.from_arrays(taken, [*batch.schema.names, "group", "visited"])

    of_place = [(int(p), int(group[p]), *parts[group[p]]) for p in np.flatnonzero(group >= 0)]
    of_place = spark.createDataFrame(of_place, "place int, group int, vector_parts int, query_parts int")
    of_group = spark.createDataFrame([(g, *p) for g, p in enumerate(parts)], "group int, vector_parts int, query_parts int")

    def part(key: str, parts: str):
        return F.pmod(F.xxhash64(key), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    keys = ["group", "query_part", "vector_part"]
    rows = held.select("vec_id", "embedding").mapInArrow(place, f"vec_id {kinds['vec_id']}, embedding array<double>, place int")
    rows = rows.join(F.broadcast(of_place), "place").select(
        "group", "place", "vec_id", "embedding", every("query_parts").alias("query_part"), part("vec_id", "vector_parts").alias("vector_part")
    )
    asked = queries.select("query_id", "embedding").mapInArrow(visit, f"query_id {kinds['query_id']}, embedding array<double>, group int, visited binary")
    asked = asked.join(F.broadcast(of_group), "group").select(
        "group", "query_id", "embedding", "visited", part("query_id", "query_parts").alias("query_part"), every("vector_parts").alias("vector_part")
    )
    schema = neighbours._hit_schema(queries, held)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            empty = [left["query_id"].slice(0, 0), right["vec_id"].slice(0, 0), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=schema.names)
        ids = right["vec_id"].combine_chunks()
        order = pc.array_sort_indices(ids).to_numpy()
        ids, wanted = ids.take(pa.array(order)), as_matrix(left["embedding"])
        vectors, places = as_matrix(right["embedding"])[order], right["place"].to_numpy()[order]
        visited = np.frombuffer(b"".join(left["visited"].to_pylist()), np.uint8).reshape(len(wanted), -1)
        own_places = of_groups[left["group"][0].as_py()]

        def of_some(wanted: np.ndarray, some: np.ndarray, visited: np.ndarray):
            # ``visited`` has a bit for each place of the group
            at = np.searchsorted(own_places, some)
            near = visited[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            return near.astype(bool), np.zeros(near.shape)

        # a bucket gives its k nearest rows: where it repeats one, these are fewer hits
        spoilt = np.isin(places, places[_repeated(ids, vectors)])
        plain = np.flatnonzero(~spoilt)
        found, cols, square = top_k_in_groups(wanted, vectors[plain], places[plain], of_some, k, block or neighbours.COMPARED, about=visited)
        cols = plain[cols]
        for own in np.unique(places[spoilt]):
            rows = np.flatnonzero(places == own)
            asked = np.flatnonzero(of_some(wanted, np.array([own]), visited)[0][:, 0])
            more = top_k(wanted[asked], vectors[rows], k) if len(asked) else (asked, asked, np.zeros(0))
            found, cols, square = _k_hits(ids, vectors, [found, asked[more[0]]], [cols, rows[more[1]]], [square, more[2]], k)
        columns = [left["query_id"].combine_chunks().take(pa.array(found)), ids.take(pa.array(cols)), pa.array(square)]
        return pa.Table.from_arrays(columns, names=schema.names)

    tasks = max(1, 2 * sum(v * q for v, q in parts))
    asked, rows = asked.repartition(tasks, *keys), rows.repartition(tasks, *keys)
    hits = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, schema)
    # families repeat each other's hits
    return hits.distinct()


def _repeated(ids: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Rows whose id and vector another row before them has; ids come in order."""
    code = pc.dictionary_encode(ids).indices.to_numpy()
    order = np.lexsort(((vectors * np.cos(np.arange(vectors.shape[1]))).sum(1), code))
    same = (code[order[1:]] == code[order[:-1]]) & (vectors[order[1:]] == vectors[order[:-1]]).all(1)
    return order[1:][same]


def _k_hits(ids: pa.Array, vectors: np.ndarray, found, cols, square, k: int):
    """The ``k`` nearest hits per query, those of equal rows once; ids come in order."""
    found, cols, square = (np.concatenate(parts) for parts in (found, cols, square))
    code = pc.dictionary_encode(ids).indices.to_numpy()[cols]
    order = np.lexsort((code, square, found))
    found, cols, square, code = found[order], cols[order], square[order], code[order]
    new = np.append(True, (found[1:] != found[:-1]) | (square[1:] != square[:-1]) | (code[1:] != code[:-1]))[: len(found)]
    found, cols, square = found[new], cols[new], square[new]
    kept = np.arange(len(found)) - np.searchsorted(found, found) < k
    return found[kept], cols[kept], square[kept]
