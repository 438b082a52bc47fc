"""Join of texts with the keys they contain, by an index of character grams.

A text contains a key only if it holds every gram of the key. So a key is looked for by one gram alone, the one that
fewest texts hold: texts and keys meet in an equi join on it, and ``contains`` settles what the gram suggests. No text
meets a key it shares no gram with, so the size of the key table does not matter to the plan.

Texts are folded to distinct ones first, and written. Of their grams only those leave a task whose hash some wanted gram has too,
by a bitmap of ``BITS`` bits: for the count those of all keys' grams, for the join those of the keys' rarest ones. Frequencies
are folded ahead of the shuffle; a gram that a large share of texts holds is nobody's rarest unless a key has no other, and
then shuffles on both sides let adaptive execution split it. The bitmap alone passes through the driver: the planner takes
keys and texts for few by the size of the columns they are made of, so joins say themselves that both sides are shuffled.

Defined results: letters are compared in lower case; a NULL or empty key is contained in nothing, and a NULL text contains
nothing; repeated rows stay; a key of fewer characters than a gram is its own gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written

#: Characters of a gram; longer ones are rarer, and each text has as many of any length.
GRAM = 6

#: Bits of the map of wanted grams (2 MB); where it is full, more rows meet in the join.
BITS = 1 << 24


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def _place(gram) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def _bitmap(grams: DataFrame) -> np.ndarray:
    """The places of ``gram`` as bits, folded by tasks; pieces of 4 KB are collected, ``BITS`` bits in all at most."""
    place = grams.select((_place("gram") + 1).alias("place"))
    pieces = place.groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    held = {r.piece - 1: np.frombuffer(r.bits, np.uint8) for r in pieces.collect()}
    length = max((len(b) for b in held.values()), default=1)
    out = np.zeros(-(-BITS // 8), np.uint8)
    for piece, bits in held.items():
        out[piece * length : piece * length + len(bits)] = bits
    return out


def _held(texts: DataFrame, lists: Column, bitmap: np.ndarray) -> DataFrame:
    """``text, gram`` of the grams in ``lists`` whose place is in ``bitmap``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, places = batch.column("grams"), batch.column("places").flatten().to_numpy()
            kept = pa.array(np.flatnonzero(bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1))
            owner = pc.list_parent_indices(grams).take(kept)
            yield pa.RecordBatch.from_arrays([batch.column("text").take(owner), grams.flatten().take(kept)], ["text", "gram"])

    made = texts.select("text", lists.alias("grams")).withColumn("places", F.transform("grams", _place))
    return made.mapInArrow(keep, "text string, gram string")


def contained_keys(texts: DataFrame, keys: DataFrame, gram: int = GRAM) -> DataFrame:
    """``text, key`` for every distinct lower-cased ``text`` of ``texts`` and ``key`` of ``keys`` it contains."""
    texts = written(texts.select(F.lower("text").alias("text")).where("text IS NOT NULL").distinct(), "texts")
    keys = keys.select(F.lower("key").alias("key")).where("key <> ''").distinct()
    size = F.least(F.length("key"), F.lit(gram))
    wanted = keys.select("key", size.alias("size"), F.explode(_grams(F.col("key"), size)).alias("gram"))
    # gram lengths in use: ``gram`` of them at most
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect())
    lists = F.concat(*[F.coalesce(_grams(F.col("text"), F.lit(n)), F.array().cast("array<string>")) for n in sizes]) if sizes else F.array().cast("array<string>")
    # grams of keys, and what shares a place with one, counted over texts; grouped by a hash beside the gram, so that the join deals them anew and can split them
    counts = _held(texts, lists, _bitmap(wanted)).select("gram")
    counts = counts.groupBy("gram", F.xxhash64("gram")).agg(F.count("*").alias("n")).select("gram", "n")
    met = wanted.join(counts.hint("merge"), "gram", "left")
    # a key one of whose grams no text holds is contained in none
    rarest = met.groupBy("key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"), F.count_if(F.col("n").isNull()).alias("missing")
    )
    rarest = written(rarest.where("missing = 0").select("key", F.col("least.gram").alias("gram")), "rarest")
    held = _held(texts, lists, _bitmap(rarest))
    return held.join(rarest.hint("merge"), "gram").where(F.contains(F.col("text"), F.col("key"))).select("text", "key")


def best_contained(rows: DataFrame, text: str, dimension: DataFrame, key: str, value: str, gram: int = GRAM) -> DataFrame:
    """``rows`` with ``key`` and ``value`` of the dimension row of largest ``value`` whose key column ``text`` contains.

    Keys of equal value are settled by their names. A row that contains none, or has no text, gets NULL.
    """
    named = dimension.select(F.col(key).alias("name"), F.lower(key).alias("key"), F.col(value).alias("value"))
    found = contained_keys(rows.select(F.col(text).alias("text")), named.select("key"), gram)
    # value first, then the name that sorts first: the largest value is the least negated one
    order = F.struct((-F.col("value")).alias("by"), "name", "value")
    best = found.join(named.hint("merge"), "key").where("value IS NOT NULL").groupBy("text").agg(F.min(order).alias("best"))
    best = best.select(F.col("text").alias("_contained_text"), F.col("best.name").alias(key), F.col("best.value").alias(value))
    return rows.join(best.hint("merge"), F.lower(rows[text]) == best["_contained_text"], "left").drop("_contained_text")
