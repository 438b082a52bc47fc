"""Document fingerprints: SimHash of weighted terms, and a search by permuted blocks.

Terms are the words of a text, each hashed with the word before it and weighted by its
length (``HEAVIEST`` at most). Bit b of the fingerprint is set when the terms whose hash has
it weigh over half of all. Votes are counted four bits to a number: a hash's nibble is spread
over four lanes of 16 bits, so sixteen sums count all 64 bits. ``LANE`` terms fit a lane;
longer texts are summed in such parts.

The search cuts fingerprints into ``BLOCKS`` blocks. Those within ``RADIUS`` bits agree in
``BLOCKS - RADIUS`` blocks or more, so in one table per choice of that many blocks, keyed by
these bits, all pairs meet. Equal fingerprints are one row of the tables; a pair is taken
from the first table in which it meets.

All of it is DataFrame functions. Documents are put next to each other by ranges of ids:
a window per range, into which the first document of the range below is copied.

Defined results: a NULL text counts as empty; a text without words has fingerprint zero.
Documents of one id follow each other by their text's hash, descending; NULL ids come last.
Rows stay one to one; other columns do not matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import written
from . import common

HEAVIEST = 15
LANE = 2048  # LANE * HEAVIEST stays below 2^15
RADIUS = 3
BLOCKS = 5
QUERIES = 100

_SPREAD, _LANES = (1 << 45) + (1 << 30) + (1 << 15) + 1, (1 << 48) + (1 << 32) + (1 << 16) + 1


# ---- fingerprints ------------------------------------------------------------

def _votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, part, weight, s0 .. s15``: votes of the terms of ``text``, summed in lanes.

    What splitting leaves of no length, at either end or in an empty text, weighs nothing.
    """
    split = rows.select(*keys, F.split(F.col(text), r"[\x20\x09-\x0D]+").alias("w"))
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.size("w") - 1)).alias("b")
    each = split.select(*keys, F.posexplode(F.arrays_zip("w", before)).alias("at_word", "term"))
    each = each.select(
        *keys,
        F.floor(F.col("at_word") / LANE).alias("part"),
        F.xxhash64(F.col("term.b"), F.col("term.w")).alias("h"),
        F.least(F.length("term.w"), F.lit(HEAVIEST)).cast("long").alias("weight"),
    )
    lane = lambda j: (
        (F.shiftrightunsigned("h", 4 * j).bitwiseAND(F.lit(15)) * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES)) * F.col("weight")
    )
    return each.groupBy(*keys, "part").agg(
        F.sum("weight").alias("weight"), *[F.sum(lane(j)).alias(f"s{j}") for j in range(16)]
    )


def _bits(votes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bits``: the fingerprint from lanes of all parts."""
    place = lambda b: F.shiftrightunsigned(f"s{b // 4}", 16 * (b % 4)).bitwiseAND(F.lit(0xFFFF))
    total = votes.groupBy(*keys).agg(F.sum("weight").alias("weight"), *[F.sum(place(b)).alias(f"v{b}") for b in range(64)])
    bits = F.lit(0).cast("long")
    for b in range(64):
        value = (1 << b) - (1 << 64 if b == 63 else 0)
        bits = bits.bitwiseOR(F.when(F.col(f"v{b}") * 2 > F.col("weight"), F.lit(value)).otherwise(F.lit(0)))
    return total.select(*keys, bits.alias("bits"))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, bits`` of the rows that ``keys`` name."""
    return _bits(_votes(rows, keys, text), keys)


def likeness(a: Column, b: Column) -> Column:
    """Share of bits in which two fingerprints agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


# ---- neighbours in id order --------------------------------------------------

def with_next(docs: DataFrame) -> DataFrame:
    """``at, place, doc_id, text, text_hash, next_text, next_hash``: the next document by descending id.

    After the last comes the first. Ranges are cut at ids and text hashes of a bounded sample, so
    documents that share an id, or have none, are spread as well; ``at, place`` is the document's
    place in them.
    """
    spark = docs.sparkSession
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, scale = held.count(), 1 << 40
    keep = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(scale)) <= int(scale * min(1.0, 20 * parts / max(rows, 1)))
    sample = held.where(keep).select("doc_id", "text_hash").distinct().limit(80 * parts).collect()
    keys = sorted((r[0] is not None, r[0] or 0, r[1]) for r in sample)
    bounds = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
    kind = docs.schema["doc_id"].dataType.simpleString()
    # NULL ids come first in the order of structs
    pair = lambda known, doc, text_hash: F.struct(F.lit(doc if known else None).cast(kind).alias("doc_id"), F.lit(text_hash).cast("long").alias("text_hash"))
    cuts = F.array(*[pair(*b) for b in sorted(set(bounds))]) if bounds else F.array().cast(f"array<struct<doc_id:{kind},text_hash:bigint>>")
    bucket = F.size(F.filter(cuts, lambda b: b <= F.struct("doc_id", "text_hash")))
    placed = held.withColumn("bucket", bucket)

    # one row per range: the document that the range above must see after its own
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "text_hash")).alias("head"))
    heads = heads.select("bucket", "head.*").collect()
    heads.sort(key=lambda r: r["bucket"])
    targets = [(r["doc_id"], r["text_hash"], above["bucket"]) for r, above in zip(heads, [*heads[1:], *heads[:1]])]
    shape = f"head_id {kind}, head_hash long, above int"
    copies = F.broadcast(spark.createDataFrame(targets, shape))
    own = placed["doc_id"].eqNullSafe(copies["head_id"]) & (placed["text_hash"] == copies["head_hash"])
    dealt = placed.join(copies, own, "left")
    places = F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("copied")), F.struct(F.col("above").alias("at"), F.lit(True).alias("copied")))
    dealt = dealt.select("doc_id", "text", "text_hash", F.inline(F.filter(places, lambda p: p["at"].isNotNull())))
    order = Window.partitionBy("at").orderBy("copied", F.desc_nulls_last("doc_id"), F.desc("text_hash"))
    both = dealt.select(
        "at", F.row_number().over(order).alias("place"), "doc_id", "text", "text_hash", "copied",
        F.lead("text").over(order).alias("next_text"), F.lead("text_hash").over(order).alias("next_hash"),
    )
    return both.where(~F.col("copied")).drop("copied")


def edited(n: Column) -> Column:
    """The text with its last third replaced by as much of the next document's beginning."""
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))


# ---- search by permuted blocks -----------------------------------------------

def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The bits that lead each permuted table, as signed 64-bit values."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(asked: DataFrame, held: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``asked, found, distance``: pairs of distinct fingerprints of ``asked(bits)`` and ``held(bits)``."""
    masks = block_masks(radius, blocks)

    def tables(df: DataFrame, name: str) -> DataFrame:
        each = df.select("bits").distinct().select("bits", F.posexplode(F.array(*map(F.lit, masks))).alias("tab", "mask"))
        return each.select(F.col("bits").alias(name), F.col("tab").alias(f"{name}_tab"), F.col("bits").bitwiseAND(F.col("mask")).alias(f"{name}_key"))

    a, b = tables(asked, "asked"), tables(held, "found")
    differ = F.col("asked").bitwiseXOR(F.col("found"))
    first = F.lit(len(masks))
    for i in reversed(range(len(masks))):
        first = F.when(differ.bitwiseAND(F.lit(masks[i])) == 0, F.lit(i)).otherwise(first)
    met = (F.col("asked_tab") == F.col("found_tab")) & (F.col("asked_key") == F.col("found_key"))
    near = a.join(b, met & (F.bit_count(differ) <= radius) & (first == F.col("asked_tab")))
    return near.select("asked", "found", F.bit_count(differ).alias("distance"))


# ---- the query ---------------------------------------------------------------

def _apart(rows: DataFrame, key: str) -> GroupedData:
    """``rows`` by ``key`` and a hash of it: a join on the key deals the groups anew, so one that many rows meet can be split."""
    return rows.groupBy(key, F.xxhash64(key).alias("_apart"))


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how like they and the next one's are."""
    rows, key = with_next(docs), ["at", "place"]
    rows = rows.withColumn("edited", edited(F.length("text")))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("own")) for i, c in enumerate(["text", "edited"])])
    both = fingerprints(rows.select(*key, F.inline(sides)), [*key, "side"], "own")
    one = lambda side, name: F.max(F.when(F.col("side") == side, F.col("bits"))).alias(name)
    bits = both.groupBy(*key).agg(one(0, "bits"), one(1, "edited_bits"))
    facts = rows.select(
        *key, "doc_id", "text_hash", "next_hash",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    known = written(facts.join(bits, key).drop(*key), "fingerprints")
    following = _apart(known, "text_hash").agg(F.max("bits").alias("next_bits")).select(F.col("text_hash").alias("next_hash"), "next_bits")
    return known.join(following, "next_hash")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document; for ids divisible by 100, how many documents are near."""
    known = compared(common.table(spark, sf_dir, "documents"))
    sizes = _apart(known, "bits").agg(F.count("*").alias("size")).drop("_apart")
    asked = known.where(F.col("doc_id") % QUERIES == 0).select("bits")
    pairs = within_radius(asked, sizes)
    near = pairs.join(sizes.withColumnRenamed("bits", "found"), "found")
    near = _apart(near, "asked").agg((F.sum("size") - 1).alias("near")).select(F.col("asked").alias("bits"), "near")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0").alias("fingerprint" if c == "bits" else "edited_fingerprint")
    return known.join(near, "bits", "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed("bits"), hexed("edited_bits"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
        F.when(F.col("doc_id") % QUERIES == 0, F.col("near")).alias("n_near"),
    )
