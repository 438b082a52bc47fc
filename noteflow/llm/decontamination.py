"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with n distinct shingles is contained in a document at ``CONTAINMENT`` when at least
c = ceil(CONTAINMENT * n) of them occur there. Items with the same shingles are sought once.

Shingles that more than ``COMMON`` different items hold say little: an item with d < c of them
does without, and then a document must hold c - d of its other n - d. The sketch is the
smallest n - c + k hashes of what is left (min-hashes). Of these a document that contains
the item holds at least k, however long it is, so the search misses nothing; k is a quarter of
the need, at least two, so that one shared phrase makes no candidate. An item made of common
shingles keeps them all.

The search is partitioned by size: items fall in classes by the number of shingles sought, each
a factor of four wide, and the largest min-hash of a class bounds what documents send to it. So
an item of a few shingles, whose min-hashes reach high, raises what is sent to its own class alone.
Shared min-hashes are counted before a text is looked at; a document then meets all its candidates
in one row (a long one in parts, by its length), first by hashes, then by the exact words
of every shingle.

Words are runs of ASCII letters and digits and all other non-ASCII characters, A-Z in lower
case. Shingles are five words.

Defined results: a NULL, empty or short text (fewer than five words) contains nothing; an
item of fewer than five words is sought nowhere. Repeated items and rows are answered once
per pair of ids. Items and documents with NULL ids are kept, as a value of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written
from . import common

SHINGLE = 5
CONTAINMENT = 0.8
#: Shingles that more different items hold are common.
COMMON = 16
#: A document meets its candidates in one part for so many of its shingles.
PART = 1 << 14

_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Odd multipliers of the words' places within a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 | 1 for i in range(SHINGLE)], np.uint64)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def shingle_hashes(found: list[bytes]) -> np.ndarray:
    """Distinct hashes of five-word shingles, ascending."""
    import xxhash

    if len(found) < SHINGLE:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, found), np.uint64, len(found))
    n = len(each) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i, place in enumerate(_PLACES):
        total += each[i : i + n] * place
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def needed(size: int, containment: float = CONTAINMENT) -> int:
    """Shingles of ``size`` that a document must hold."""
    return math.ceil(round(containment * size, 9))


def _ordered(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed ones in the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def shingle_sets(items: DataFrame) -> DataFrame:
    """``item_id, set_id, hashes, text`` of every item with a shingle; items of one ``set_id`` have the same ones."""

    def run(stream):
        def rows(batch):
            for item, text in zip(batch.column("item_id").to_pylist(), common.texts(batch)):
                own = shingle_hashes(words(text))
                if len(own):
                    yield item, _ordered(own).tolist(), (text or b"").decode()

        for batch in stream:
            schema = pa.schema([batch.schema.field("item_id"), ("hashes", pa.list_(pa.int64())), ("text", pa.string())])
            yield from common.batches(rows(batch), schema, lambda r: 8 * len(r[1]) + len(r[2]) + 32)

    held = items.select("item_id", "text")
    kind = held.schema["item_id"].dataType.simpleString()
    found = held.mapInArrow(run, f"item_id {kind}, hashes array<long>, text string")
    return found.select("item_id", F.xxhash64("hashes").alias("set_id"), "hashes", "text")


def sketches(sets: DataFrame, containment: float = CONTAINMENT, common_items: int = COMMON) -> DataFrame:
    """``set_id, size_class, at_least, min_hash``: what is sought of every ``sets(set_id, hashes)``.

    A document that contains the set holds ``at_least`` of its min-hashes.
    """
    each = sets.groupBy("set_id").agg(F.first("hashes").alias("hashes")).select("set_id", F.explode("hashes").alias("min_hash"))
    often = each.groupBy("min_hash").count().where(F.col("count") > common_items).select("min_hash", F.lit(True).alias("often"))
    parts = each.join(often, "min_hash", "left").groupBy("set_id").agg(
        F.count("*").alias("n"),
        F.collect_list("min_hash").alias("all"),
        F.collect_list(F.expr("CASE WHEN often IS NULL THEN min_hash END")).alias("telling"),
    )
    need = F.ceil(F.round(F.col("n") * containment, 9))
    told = need > F.col("n") - F.size("telling")
    parts = parts.select(
        "set_id",
        F.sort_array(F.when(told, F.col("telling")).otherwise(F.col("all"))).alias("sought"),
        F.when(told, need - F.col("n") + F.size("telling")).otherwise(need).cast("int").alias("need"),
    )
    at_least = F.least("need", F.greatest(F.lit(2), F.ceil(F.col("need") / 4).cast("int")))
    parts = parts.select(
        "set_id",
        F.floor((F.length(F.bin(F.size("sought"))) + 1) / 2).cast("int").alias("size_class"),
        at_least.alias("at_least"),
        F.slice("sought", F.lit(1), F.size("sought") - F.col("need") + at_least).alias("sketch"),
    )
    return parts.select("set_id", "size_class", "at_least", F.explode("sketch").alias("min_hash"))


def class_bounds(sketch: DataFrame) -> dict[int, int]:
    """The largest min-hash of each size class; classes are as many as a size has pairs of bits."""
    return {r["size_class"]: r["bound"] for r in sketch.groupBy("size_class").agg(F.max("min_hash").alias("bound")).collect()}


def sent_hashes(docs: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """``doc_id, text_hash, parts, size_class, min_hash``: each document's hashes up to the bound of each class."""
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    classes = sorted(bounds.items())

    def run(stream):
        def sent(batch, taken, parts, kinds, found):
            counts = [len(f) for f in found]
            at = pa.array(np.repeat(np.array(taken), counts))
            columns = [batch.column(n).take(at) for n in ("doc_id", "text_hash")]
            numbers = [pa.array(np.repeat(np.array(x, np.int32), counts)) for x in (parts, kinds)]
            hashes = pa.array(np.concatenate(found))
            return pa.RecordBatch.from_arrays([*columns, *numbers, hashes], ["doc_id", "text_hash", "parts", "size_class", "min_hash"])

        for batch in stream:
            taken, parts, kinds, found, size = [], [], [], [], 0
            for at, text in enumerate(common.texts(batch)):
                own = _ordered(shingle_hashes(words(text)))
                for kind, bound in classes:
                    low = own[: np.searchsorted(own, bound, "right")]
                    if len(low):
                        taken.append(at)
                        parts.append(1 + len(own) // PART)
                        kinds.append(kind)
                        found.append(low)
                        size += len(low)
                if size > 1 << 18:
                    yield sent(batch, taken, parts, kinds, found)
                    taken, parts, kinds, found, size = [], [], [], [], 0
            if found:
                yield sent(batch, taken, parts, kinds, found)

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc_id {kind}, text_hash long, parts int, size_class int, min_hash long")


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """``doc_id, text_hash, set_id, parts`` of documents that hold as many min-hashes of a set as they must.

    Rows equal in id and text add up, which may make a candidate and never loses one.
    """
    met = sent_hashes(docs, class_bounds(sketch)).join(sketch, ["size_class", "min_hash"])
    shared = met.groupBy("doc_id", "text_hash", "set_id").agg(
        F.count("*").alias("n"), F.first("at_least").alias("at_least"), F.first("parts").alias("parts")
    )
    return shared.where("n >= at_least").select("doc_id", "text_hash", "set_id", "parts")


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, text_hash, item_id, n_shared, n_shingles, containment`` of all pairs at or over it."""
    sets = written(shingle_sets(items), "item-shingles")
    sketch = written(sketches(sets, containment), "sketches")
    pairs = written(candidates(docs, sketch), "candidates")

    texts = sets.groupBy("set_id").agg(F.min("text").alias("item_text"))
    listed = pairs.join(texts, "set_id").groupBy("doc_id", "text_hash", F.pmod("set_id", "parts").alias("part"))
    listed = listed.agg(F.collect_list(F.struct("set_id", "item_text")).alias("asked"))
    asked = listed.withColumnsRenamed({"doc_id": "d", "text_hash": "th"})
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    both = held.join(asked, held["doc_id"].eqNullSafe(asked["d"]) & (held["text_hash"] == asked["th"]))
    both = both.select("doc_id", "text_hash", "asked", "text")

    def run(stream):
        def rows(batch):
            ids = (batch.column(n).to_pylist() for n in ("doc_id", "text_hash"))
            for doc, text_hash, asked, text in zip(*ids, batch.column("asked"), common.texts(batch)):
                split = words(text)
                hashes, joined = shingle_hashes(split), b" %s " % b" ".join(split)
                for one in asked.as_py():
                    own = words(one["item_text"].encode())
                    least = shingle_hashes(own)
                    if np.isin(least, hashes, assume_unique=True).sum() < needed(len(least), containment):
                        continue
                    sought = {b" %s " % b" ".join(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)}
                    shared = sum(s in joined for s in sought)
                    if shared >= needed(len(sought), containment):
                        yield doc, text_hash, one["set_id"], shared, len(sought), shared / len(sought)

        for batch in stream:
            schema = pa.schema(
                [batch.schema.field("doc_id"), ("text_hash", pa.int64()), ("set_id", pa.int64()),
                 ("n_shared", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64())]
            )
            yield from common.batches(rows(batch), schema, lambda r: 48)

    kind = held.schema["doc_id"].dataType.simpleString()
    found = both.mapInArrow(
        run, f"doc_id {kind}, text_hash long, set_id long, n_shared long, n_shingles long, containment double"
    ).distinct()
    found = found.join(sets.select("set_id", "item_id").distinct(), "set_id")
    return found.select("doc_id", "text_hash", "item_id", "n_shared", "n_shingles", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows that contain an item; same columns."""
    found = written(contained(docs, items, containment).select("doc_id", "text_hash").distinct(), "contaminated")
    found = found.toDF("_found_doc", "_found_text")
    same = docs["doc_id"].eqNullSafe(found["_found_doc"]) & (F.xxhash64(docs["text"]) == found["_found_text"])
    return docs.join(found, same, "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item it contains."""
    docs, items = (common.table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    found = contained(docs, items)
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", F.round("containment", 6).alias("containment")).distinct()


OP4_SQL = r"""
WITH worded AS (
  SELECT 'doc' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'item', item_id, text FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM worded
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT kind, id, words, unnest(range(1, len(words) - 3)) AS i FROM split)
), sizes AS (
  SELECT id, count(*) AS n FROM shingles WHERE kind = 'item' GROUP BY id
)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n AS n_shingles,
       round(count(*) / n, 6) AS containment
FROM shingles d JOIN shingles i ON d.shingle = i.shingle AND d.kind = 'doc' AND i.kind = 'item'
JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id, n HAVING count(*) >= 0.8 * n
"""
