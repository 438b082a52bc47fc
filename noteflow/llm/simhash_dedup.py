"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits are 32 segments of two bits; counting the set bits of each embeds it
in a grid of points with 32 coordinates from 0 to 2. The Manhattan distance of two points is
never more than the Hamming distance of the fingerprints. Written in unary (0, 01, 11) the
counts fill 64 bits again, and the Manhattan distance is the number of bits in which two
such words differ.

Range join: the coordinates are cut into ``BANDS`` bands. Points within distance ``RADIUS``
agree wholly in ``BANDS - RADIUS`` bands at least, so every choice of that many bands is a
grid whose cells bring all such pairs together. In a cell the Manhattan distance is tested
first, then the fingerprints exactly. More bands make smaller cells and more grids; their number
follows the counted fingerprints, ``BANDS`` at least (up to some 10^7 of them). A cell of ``CELL`` fingerprints or fewer is one unit of
work; a larger one is cut into parts, and each pair of parts is a unit. A unit returns a
spanning forest of its links and never its pairs. Equal fingerprints are folded beforehand.

Defined results: a NULL or empty text, or one without words, has fingerprint zero and is
linked like any other; fewer than four words are one shingle. Rows stay one to one. The
component of rows that all lack an id is NULL.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import written
from . import common
from .components import components

SHINGLE = 4
RADIUS = 4
BANDS, MOST_BANDS = 6, 16
CELL = 8192
#: Comparisons that take as long as dealing one fingerprint to a cell.
DEAL = 200
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is set when it is set in over half of the shingles' hashes; as a signed 64-bit value."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    pairs = zip(begins, ends[size - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, bits`` of every whole text."""
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(stream):
        for batch in stream:
            bits = [fingerprint(text or b"", shingle) for text in common.texts(batch)]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(bits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "bits"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc_id {kind}, text_hash long, bits long")


def popcounts(bits: Column) -> Column:
    """Counts of set bits per two-bit segment, in unary: the embedding's point."""
    even = F.lit(0x5555555555555555)
    upper, lower = F.shiftrightunsigned(bits, 1).bitwiseAND(even), bits.bitwiseAND(even)
    return F.shiftleft(upper.bitwiseAND(lower), 1).bitwiseOR(upper.bitwiseOR(lower))


def bands_for(count: int, radius: int = RADIUS) -> int:
    """The number of bands that makes the least work of ``count`` fingerprints.

    Two random points agree in a two-bit segment with probability 3/8; a grid compares the pairs
    that agree in all segments of ``bands - radius`` bands.
    """

    def work(bands: int) -> float:
        met = 0.375 ** (32 * (bands - radius) / bands)
        return comb(bands, radius) * (DEAL * count + count * count / 2 * met)

    return min(range(max(BANDS, radius + 1), max(MOST_BANDS, radius + 2) + 1), key=work)


def grid_masks(radius: int = RADIUS, bands: int = BANDS) -> list[int]:
    """The bits of each choice of ``bands - radius`` bands, as signed 64-bit values."""
    cuts = [2 * round(32 * i / bands) for i in range(bands + 1)]
    band = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(band, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS, cell: int = CELL) -> DataFrame:
    """``a, b``: links that connect all of ``distinct(bits)`` that lie within ``radius``, perhaps through others."""
    masks = F.array([F.lit(m) for m in grid_masks(radius, bands)])
    points = distinct.select("bits", popcounts(F.col("bits")).alias("point"))
    placed = points.select("bits", F.posexplode(masks).alias("grid", "mask"), "point")
    placed = placed.select("bits", "grid", F.col("point").bitwiseAND(F.col("mask")).alias("cell"))
    sizes = placed.groupBy("grid", "cell").count().where("count > 1")
    sizes = sizes.select("grid", "cell", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    crowded = placed.join(sizes, ["grid", "cell"]).withColumn("part", part)
    # part p meets every other part once: as the first of (p, q) for q >= p, else as the second
    met = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    units = crowded.select("grid", "cell", "bits", "part", met)
    units = units.select(
        "grid", "cell", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "bits"
    )
    key = ["grid", "cell", "first", "second"]
    dealt = units.repartition(*key).sortWithinPartitions(*key, "part")
    return dealt.mapInArrow(lambda stream: _forests(stream, radius), "a long, b long").distinct()


def _forests(stream, radius: int):
    """Spanning forests of the units in a sorted stream."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows():
        held: list[np.ndarray] = []
        now = None
        for batch in stream:
            key = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], 1)
            sides = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[4:6]], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                own = tuple(key[a].tolist())
                if own != now:
                    if now is not None:
                        yield from _forest(now, held, radius)
                    now, held = own, []
                held.append(sides[a:b])
        if now is not None:
            yield from _forest(now, held, radius)

    yield from common.batches(rows(), schema, lambda r: 16)


def _forest(key: tuple, held: list[np.ndarray], radius: int):
    sides = held[0] if len(held) == 1 else np.concatenate(held)
    if len(sides) < 2:
        return
    bits = sides[:, 1].view(np.uint64) if sides.flags.c_contiguous is False else sides[:, 1].copy().view(np.uint64)
    first = bits if key[2] == key[3] else bits[sides[:, 0] == key[2]]
    second = bits if key[2] == key[3] else bits[sides[:, 0] == key[3]]
    points = _points(second)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    block = max(1, (1 << 20) // max(len(second), 1))
    for at in range(0, len(first), block):
        some = first[at : at + block]
        i, j = np.nonzero(np.bitwise_count(_points(some)[:, None] ^ points[None, :]) <= radius)
        near = np.bitwise_count(some[i] ^ second[j]) <= radius
        for a, b in zip(some[i[near]].view(np.int64).tolist(), second[j[near]].view(np.int64).tolist()):
            if a < b or (a > b and key[2] != key[3]):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    for x in list(parent):
        if (r := root(x)) != x:
            yield r, x


def _points(bits: np.ndarray) -> np.ndarray:
    even = np.uint64(0x5555555555555555)
    upper, lower = (bits >> np.uint64(1)) & even, bits & even
    return ((upper & lower) << np.uint64(1)) | upper | lower


def classes(docs: DataFrame, radius: int = RADIUS, bands: int | None = None) -> DataFrame:
    """``doc_id, text_hash, bits, root, component_id``: every row with the smallest id it is linked to.

    ``root``, the component's smallest fingerprint, tells components apart; ids need not.
    """
    marked = written(fingerprints(docs), "fingerprints")
    if bands is None:
        bands = bands_for(marked.agg(F.approx_count_distinct("bits")).first()[0], radius)
    distinct = marked.groupBy("bits").agg(F.min("doc_id").alias("smallest"))
    rooted = components(links(distinct.select("bits"), radius, bands))
    # a fingerprint without links is its own root
    of = distinct.join(rooted.withColumnRenamed("node", "bits"), "bits", "left")
    of = written(of.select("bits", "smallest", F.coalesce("root", "bits").alias("root")), "roots")
    # grouped by a zero beside the root, so that the join deals both sides anew and a root that
    # very many fingerprints share can be split
    least = of.groupBy("root", F.col("root") % 1).agg(F.min("smallest").alias("component_id")).select("root", "component_id")
    named = written(of.join(least, "root").select("bits", "root", "component_id"), "components")
    return marked.join(named, "bits").select("doc_id", "text_hash", "bits", "root", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, the first of its texts."""
    found = classes(docs)
    # by root: components may share an id, and rows without one go after all others
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    stays = found.groupBy("root").agg(first)
    doc, text, rank = common.fresh(docs, "_stays_doc", "_stays_text", "_stays_rank")
    stays = stays.select(F.col("first.doc_id").alias(doc), F.col("first.text_hash").alias(text))
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(stays[doc]) & (F.xxhash64(docs["text"]) == stays[text]))
    # rows equal in id and text are one document
    kept = kept.withColumn(rank, F.row_number().over(Window.partitionBy(doc, text).orderBy(F.lit(1)))).where(f"{rank} = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
