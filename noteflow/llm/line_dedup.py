"""Line deduplication by range-partitioned hashes.

Each document gives one narrow row per distinct key of its lines. The rows are partitioned
by range of (key hash, document, descending, text hash) and sorted, so a partition is a stream
of keys whose first document is the one that keeps the line. A key that many rows share is spread
over several ranges, since the document is part of the range, and so is one that many rows of one
id share. A stream holds ``WAITING`` rows at most; what its neighbours hold is told by two rows per
partition, and one per key with more waiting rows than that. Rows equal in id and text give their
keys once per task. The result is not text but one compressed bitmap per document that loses lines.

Keys: the line stripped of ASCII white space at both ends, A-Z in lower case, hashed to 128
bits. Keys of ``MIN_CHARACTERS`` code points found in ``MIN_DOCUMENTS`` documents (distinct
ids) lose all their lines but those of the largest id holding them.

Defined results: a NULL or empty text is one empty line. A NULL id is one document, smaller
than all others. Rows that repeat an id with other texts count as one document; each row gets
its own bitmap, equal rows the same. Other columns pass through unchanged.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written
from . import common

MIN_CHARACTERS = 20
MIN_DOCUMENTS = 3

#: Rows of a key's second document held until a third document shows that they go.
WAITING = 1024
#: Rows whose hashes a task remembers, to pass over equal ones.
REMEMBERED = 1 << 16
#: Edges beyond this number are joined by a shuffle.
BROADCAST_EDGES = 1 << 20

DROPPED, PENDING, EDGE = 0, 1, 2


def line_keys(docs: DataFrame, min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """``high, low, doc_id, text_hash, lines``: who holds which key, on which of its lines."""
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")

    def run(stream):
        import xxhash

        seen: set = set()

        def rows(batch):
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            for doc, text_hash, text in zip(ids, hashes, common.texts(batch)):
                if (doc, text_hash) in seen:
                    continue
                if len(seen) == REMEMBERED:
                    seen.clear()
                seen.add((doc, text_hash))
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.split(b"\n")):
                    key = line.strip().lower()
                    if len(key) >= min_characters and (
                        len(key) >= 4 * min_characters or len(key.decode()) >= min_characters
                    ):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                for digest, lines in found.items():
                    high, low = np.frombuffer(digest, np.int64).tolist()
                    yield high, low, doc, text_hash, lines

        for batch in stream:
            schema = pa.schema(
                [("high", pa.int64()), ("low", pa.int64()), batch.schema.field("doc_id"), ("text_hash", pa.int64()), ("lines", pa.list_(pa.int32()))]
            )
            yield from common.batches(rows(batch), schema, lambda r: 48 + 4 * len(r[4]))

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"high long, low long, doc_id {kind}, text_hash long, lines array<int>")


def _decisions(keys: DataFrame, min_documents: int) -> DataFrame:
    """Rows to drop, rows that wait for other rows, and what must be known of these.

    ``keys`` comes sorted by key, then document, descending. Of a key that may go on beyond
    the partition's end, began before it, or has rows that are no longer held, an ``EDGE`` row
    tells its largest and smallest document and its number of documents here.
    """

    def run(stream):
        def rows():
            now, doc, count, largest, told, first, waiting = None, None, 0, None, False, True, []
            for batch in stream:
                for high, low, own, text_hash, lines in zip(*(c.to_pylist() for c in batch.columns)):
                    if (high, low) != now:
                        if now is not None and (first or told):
                            yield EDGE, *now, largest, None, None, count, doc
                        first = now is None
                        now, count, largest, told, waiting = (high, low), 0, own, False, []
                    if not count or own != doc:
                        doc, count = own, count + 1
                    row = (high, low, own, text_hash, lines)
                    if first:
                        yield PENDING, *row, None, None
                    elif count >= min_documents:
                        for r in waiting:
                            yield DROPPED, *r, None, None
                        waiting = []
                        yield DROPPED, *row, None, None
                    elif count > 1:
                        waiting.append(row)
                        if len(waiting) > WAITING:
                            for r in waiting:
                                yield PENDING, *r, None, None
                            told, waiting = True, []
            if now is not None:
                for r in waiting:
                    yield PENDING, *r, None, None
                yield EDGE, *now, largest, None, None, count, doc

        yield from common.batches(rows(), schema, lambda r: 64 + 4 * len(r[5] or ()))

    kind = keys.schema["doc_id"].dataType.simpleString()
    declared = f"state int, high long, low long, doc_id {kind}, text_hash long, lines array<int>, documents long, smallest {kind}"
    schema = pa.schema(
        [("state", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("doc_id", _arrow(keys)),
         ("text_hash", pa.int64()), ("lines", pa.list_(pa.int32())), ("documents", pa.int64()), ("smallest", _arrow(keys))]
    )
    return keys.mapInArrow(run, declared)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


def keep_bitmaps(
    docs: DataFrame, min_characters: int = MIN_CHARACTERS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``doc_id, text_hash, keep`` of documents that lose lines; lines past the bits stay."""
    keys = written(line_keys(docs, min_characters), "line-keys")
    order = ["high", "low", F.desc_nulls_last("doc_id"), "text_hash"]
    streams = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    decided = written(_decisions(streams, min_documents), "line-decisions")

    # a document that goes on from one range into the next is an end of both
    told = decided.where(F.col("state") == EDGE)
    ends = F.array(F.struct(F.col("doc_id").alias("end")), F.struct(F.col("smallest").alias("end")))
    edges = told.groupBy("high", "low", F.xxhash64("low").alias("apart")).agg(
        (F.sum(F.greatest(F.col("documents") - 2, F.lit(0))) + F.size(F.array_distinct(F.flatten(F.collect_set(ends))))).alias("all_documents"),
        F.max("doc_id").alias("keeper"),
    ).drop("apart")
    # the hash beside the key lets a join by shuffle deal both sides anew, so hot keys can be split
    edges = F.broadcast(edges) if told.count() <= BROADCAST_EDGES else edges
    waiting = decided.where(F.col("state") == PENDING).drop("documents", "smallest").join(edges, ["high", "low"])
    waiting = waiting.where((F.col("all_documents") >= min_documents) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))

    columns = ["doc_id", "text_hash", "lines"]
    lost = decided.where(F.col("state") == DROPPED).select(columns).union(waiting.select(columns))
    per_row = lost.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("lines")).alias("lines"))

    @F.arrow_udf("binary")
    def bitmap(lines: pa.Array) -> pa.Array:
        packed = []
        for each in lines:
            at = each.values.to_numpy()
            keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
            keep[at] = False
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        return pa.array(packed, pa.binary())

    return per_row.select("doc_id", "text_hash", bitmap("lines").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, names: tuple[str, ...] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """``docs`` with the lines gone, and two counts under ``names``: lines before, and dropped; NULL texts stay NULL.

    Without names there are no counts; a name that ``docs`` has already is an error.
    """
    common.unused(docs, names)

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def cut(text: pa.Array, keep: pa.Array) -> pa.Array:
        kept, counts, dropped = [], [], []
        for value, bits in zip(text.cast(pa.binary()), keep):
            whole = value.as_py()
            counts.append((whole or b"").count(b"\n") + 1)
            if not bits.is_valid or whole is None:
                kept.append(whole)
                dropped.append(0)
                continue
            lines = whole.split(b"\n")
            packed = np.frombuffer(zlib.decompress(bits.as_py()), np.uint8)
            lost = np.flatnonzero(np.unpackbits(packed, bitorder="little")[: len(lines)] == 0)
            for at in lost:
                lines[at] = None
            kept.append(b"\n".join([x for x in lines if x is not None]))
            dropped.append(len(lost))
        parts = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.StructArray.from_arrays(parts, ["text", "n_lines", "n_dropped"])

    of, own_text, bits, done = common.fresh(docs, "_mark_doc", "_mark_text", "_mark_keep", "_mark_cut")
    marks = bitmaps.toDF(of, own_text, bits)
    same = docs["doc_id"].eqNullSafe(marks[of]) & (F.xxhash64(docs["text"]) == marks[own_text])
    joined = docs.join(marks, same, "left").withColumn(done, cut(docs["text"], F.col(bits)))
    own = [F.col(f"{done}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    counts = [F.col(f"{done}.{n}").alias(name) for n, name in zip(("n_lines", "n_dropped"), names)]
    return joined.select(*own, *counts)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated lines, same columns, same rows."""
    return apply_bitmaps(docs, keep_bitmaps(docs), names=())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines lost by each document, and a digest of what is left."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    return cut.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
