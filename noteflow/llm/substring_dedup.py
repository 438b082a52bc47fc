"""Substring deduplication by level-wise doubling.

A window of words can occur twice only if each of its halves does, and their halves. So lengths
go from ``LEAST`` words or more, doubling, to the window (35: 18, 35; 100: 25, 50, 100). Each level
counts the seeds of its length that lie in windows still alive; windows that hold a repeated one
live on to the next level, of twice the length, until the windows themselves are counted or none
is left. Seeds are chosen by content: of the seeds in any window the one with the smallest hash is
chosen (all of them, in a tie), so equal windows have an equal chosen seed at the same place, and
of 18 words about one word in ten starts a chosen seed. Levels below ``LEAST`` would keep nearly
everything alive and cost a shuffle each.

Counting folds before its shuffle and gathers nothing, so a passage that very many documents
share costs no more than any other. At the last level nearly all windows are repeated,
so what comes back to the documents are the windows that are not. Documents are partitioned
once; the plan uses that exchange for both the last level and the removal. A collision of seeds'
64-bit hashes keeps a window alive, no more. Windows count as repeated if they agree in two
independent hashes of 96 bits in all: among 10^13 windows one false pair is expected in a thousand corpora.

Defined results: words are runs of anything but ASCII white space, unchanged. A NULL text has
no words. Rows that are equal in id and text are two documents like any others, so windows
of both are repeated. Rows stay one to one; other columns pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written
from . import common

WINDOW = 35
#: No level has shorter seeds, unless the window is shorter.
LEAST = 16


def levels(window: int, least: int = LEAST) -> list[int]:
    """Lengths, ascending to ``window``, each at most twice the one before."""
    found = [window]
    while (found[0] + 1) // 2 >= least:
        found.insert(0, (found[0] + 1) // 2)
    return found


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x165667B19E3779F9))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _longer(hashes: np.ndarray, now: int, wanted: int) -> np.ndarray:
    """Hashes of windows of ``wanted`` words from those of ``now`` words, ``wanted <= 2 * now``."""
    step = wanted - now
    return _mix(hashes[: len(hashes) - step], hashes[step:])


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words, from the words' own; empty if there are fewer."""
    if len(hashes) < length:
        return hashes[:0]
    now = 1
    while now < length:
        wanted = min(2 * now, length)
        hashes, now = _longer(hashes, now, wanted), wanted
    return hashes


def seed_hashes(words: list[bytes], seed: int) -> np.ndarray:
    """The hash of each run of ``seed`` words."""
    return run_hashes(word_hashes(words), seed)


def window_checks(hashes: np.ndarray, window: int) -> np.ndarray:
    """32 further bits of each window, whose own words' hashes are others."""
    return (run_hashes(_mix(hashes, ~hashes), window) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    now = 1
    while now < size:
        step = min(now, size - now)
        values, now = pick(values[:-step], values[step:]), now + step
    return values


def chosen(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of the seeds that are smallest among some ``size`` neighbours."""
    smallest = _sliding(hashes, size, np.minimum)
    rim = np.zeros(size - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([rim, smallest, rim]), size, np.maximum) == hashes)


def _numbers(kind: pa.DataType, arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values).cast(kind))


def _seeds(docs: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """``doc_id, text_hash, n_words`` of every text with a window, and ``seeds_l, places_l`` of each length."""
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    names = ["doc_id", "text_hash", "n_words", *(f"{n}_{l}" for l in lengths for n in ("seeds", "places"))]

    def run(stream):
        def sent(batch, taken, counts, found):
            columns = [batch.column(n).take(pa.array(taken)) for n in ("doc_id", "text_hash")]
            lists = []
            for l in range(len(lengths)):
                lists += [_numbers(pa.int64(), [f[l][0] for f in found]), _numbers(pa.int32(), [f[l][1] for f in found])]
            return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), *lists], names)

        for batch in stream:
            taken, counts, found, size = [], [], [], 0
            for at, text in enumerate(common.texts(batch)):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                own, now, each = word_hashes(words), 1, []
                for l in lengths:
                    own, now = run_hashes(own, l) if now == 1 else _longer(own, now, l), l
                    places = chosen(own, window - l + 1)
                    each.append((own[places].view(np.int64), places))
                    size += len(places)
                taken.append(at)
                counts.append(len(words))
                found.append(each)
                if size > 1 << 18:
                    yield sent(batch, taken, counts, found)
                    taken, counts, found, size = [], [], [], 0
            if taken:
                yield sent(batch, taken, counts, found)

    kind = held.schema["doc_id"].dataType.simpleString()
    lists = "".join(f", seeds_{l} array<long>, places_{l} array<int>" for l in lengths)
    return held.mapInArrow(run, f"doc_id {kind}, text_hash long, n_words int{lists}")


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as ranges ``[from, to)``."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    if not len(starts):
        return starts, starts
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + 1


def _spread(froms: pa.Scalar, tos: pa.Scalar, count: int) -> np.ndarray:
    """Whether each of ``count`` starts lies in one of the ranges."""
    marks = np.zeros(count + 1, np.int32)
    marks[froms.values.to_numpy()] += 1
    marks[tos.values.to_numpy()] -= 1
    return np.cumsum(marks[:-1]) > 0


def _alive(window: int, length: int):
    """Column function: the ranges of starts alive whose windows hold a seed of ``length`` at one of ``places``."""

    @F.arrow_udf("struct<froms: array<int>, tos: array<int>>")
    def ranges(places: pa.Array, n_words: pa.Array, froms: pa.Array, tos: pa.Array) -> pa.Array:
        first, last = [], []
        for own, n, f, t in zip(places, n_words.to_pylist(), froms, tos):
            at = own.values.to_numpy()
            count = n - window + 1
            marks = np.zeros(count + 1, np.int32)
            np.add.at(marks, np.maximum(at - (window - length), 0), 1)
            np.add.at(marks, np.minimum(at + 1, count), -1)
            a, b = _runs(np.flatnonzero((np.cumsum(marks[:-1]) > 0) & _spread(f, t, count)))
            first.append(a)
            last.append(b)
        return pa.StructArray.from_arrays([_numbers(pa.int32(), first), _numbers(pa.int32(), last)], ["froms", "tos"])

    return ranges


def _within(window: int, length: int):
    """Column function: the seeds of ``length`` that lie in a window alive."""

    @F.arrow_udf("array<struct<seed: bigint, place: int>>")
    def near(seeds: pa.Array, places: pa.Array, n_words: pa.Array, froms: pa.Array, tos: pa.Array) -> pa.Array:
        ends, kept, at = [0], [], []
        for own, place, n, f, t in zip(seeds, places, n_words.to_pylist(), froms, tos):
            count, p = n - window + 1, place.values.to_numpy()
            before = np.concatenate([[0], np.cumsum(_spread(f, t, count))])
            stays = before[np.minimum(p + 1, count)] > before[np.maximum(p - (window - length), 0)]
            kept.append(own.values.to_numpy()[stays])
            at.append(p[stays])
            ends.append(ends[-1] + len(at[-1]))
        flat = [pa.array(np.concatenate(x)) if x else pa.array([], k) for x, k in ((kept, pa.int64()), (at, pa.int32()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["seed", "place"]))

    return near


def survivors(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``doc_id, text_hash, row, n_words, froms, tos``: ranges of starts of windows alive after all levels of seeds."""
    lengths = levels(window, least)[:-1]
    alive = _seeds(docs, window, lengths).withColumn("row", F.monotonically_increasing_id())
    alive = written(
        alive.withColumns({"froms": F.array(F.lit(0)), "tos": F.array(F.col("n_words") - (window - 1))}), "seeds"
    )
    for length in lengths:
        names = [f"seeds_{length}", f"places_{length}"]
        inside = F.arrays_zip(*names) if length == lengths[0] else _within(window, length)(*names, "n_words", "froms", "tos")
        each = alive.select("row", F.inline(inside)).toDF("row", "seed", "place")
        # grouped by a zero beside the seed, so that the join deals both sides anew and a seed that
        # very many documents share can be split
        twice = each.groupBy("seed", F.col("seed") % 1).count().where("count > 1").select("seed")
        found = each.join(twice, "seed").groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("places"))
        alive = alive.drop(*names).join(found, "row")
        alive = alive.withColumn("ranges", _alive(window, length)("places", "n_words", "froms", "tos"))
        alive = alive.withColumns({n: F.col(f"ranges.{n}") for n in ("froms", "tos")}).drop("places", "ranges")
        alive = alive.where(F.size("froms") > 0)
        if length != lengths[-1]:
            alive = written(alive, f"alive-{length}")
            if alive.isEmpty():
                break
    # rows equal in id and text have the same ranges
    rest = ("n_words", "froms", "tos")
    folded = alive.groupBy("doc_id", "text_hash").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in rest))
    return written(folded, "survivors")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """``hash, check, row, start``: every window that starts in ``froms`` to ``tos``."""

    def run(stream):
        def sent(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["hash", "check", "row", "start"])

        for batch in stream:
            parts, size = [], 0
            columns = (batch.column("row").to_pylist(), batch.column("froms"), batch.column("tos"), common.texts(batch))
            for row, froms, tos, text in zip(*columns):
                words = word_hashes(text.split())
                own = run_hashes(words, window)
                at = np.flatnonzero(_spread(froms, tos, len(own)))
                checks = window_checks(words, window)
                parts.append((own[at].view(np.int64), checks[at], np.full(len(at), row), at.astype(np.int32)))
                size += len(at)
                if size > 1 << 18:
                    yield sent(parts)
                    parts, size = [], 0
            if parts:
                yield sent(parts)

    return docs.select("row", "froms", "tos", "text").mapInArrow(run, "hash long, check int, row long, start int")


def _marked(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` with the columns of ``marks(doc_id, text_hash, ...)``, which has a row once; no others may be alike."""
    doc, text = common.fresh(docs, "_mark_doc", "_mark_text")
    renamed = marks.withColumnsRenamed({"doc_id": doc, "text_hash": text})
    return docs.join(renamed, docs["doc_id"].eqNullSafe(renamed[doc]) & (F.xxhash64(docs["text"]) == renamed[text]), how)


def repeated_spans(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``doc_id, text_hash, begins, ends``: word ranges that repeated windows cover, merged."""
    if window < 1:
        raise ValueError("a window has one word at least")
    around = survivors(docs, window, least)
    windows = _windows(_marked(docs.select("doc_id", "text"), around, "inner"), window)
    once = windows.groupBy("hash", "check").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("start").alias("start"))
    once = once.where("n = 1").groupBy("row").agg(F.collect_list("start").alias("single"))
    seen = around.join(once, "row", "left")

    @F.arrow_udf("struct<begins: array<int>, ends: array<int>>")
    def spans(froms: pa.Array, tos: pa.Array, single: pa.Array, n_words: pa.Array) -> pa.Array:
        begins, ends = [], []
        for f, t, lost, n in zip(froms, tos, single, n_words.to_pylist()):
            stays = _spread(f, t, n - window + 1)
            if lost.is_valid:
                stays[lost.values.to_numpy()] = False
            at = np.flatnonzero(stays)
            cut = np.flatnonzero(np.diff(at) > window)
            begins.append(at[np.concatenate([[0], cut + 1])] if len(at) else at)
            ends.append(at[np.concatenate([cut, [len(at) - 1]])] + window if len(at) else at)
        return pa.StructArray.from_arrays([_numbers(pa.int32(), begins), _numbers(pa.int32(), ends)], ["begins", "ends"])

    covered = seen.select("doc_id", "text_hash", spans("froms", "tos", "single", "n_words").alias("spans"))
    return covered.select("doc_id", "text_hash", "spans.*")


def remove(docs: DataFrame, spans: DataFrame, names: tuple[str, ...] = ("_n_words", "_n_removed")) -> DataFrame:
    """``docs`` with the words left over as ``text``, and two counts under ``names``: words before, and removed.

    Without names there are no counts; a name that ``docs`` has already is an error.
    """
    common.unused(docs, names)

    @F.arrow_udf("struct<text: string, n_words: bigint, n_removed: bigint>")
    def cut(text: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        kept, counts, removed = [], [], []
        for value, first, last in zip(text.cast(pa.binary()), begins, ends):
            words = (value.as_py() or b"").split()
            counts.append(len(words))
            if first.is_valid:
                edges = zip([0, *last.values.to_pylist()], [*first.values.to_pylist(), len(words)])
                words = [w for a, b in edges for w in words[a:b]]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words) if value.is_valid else None)
        parts = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        return pa.StructArray.from_arrays(parts, ["text", "n_words", "n_removed"])

    first, last, done = common.fresh(docs, "_mark_begins", "_mark_ends", "_mark_cut")
    spans = spans.select("doc_id", "text_hash", F.col("begins").alias(first), F.col("ends").alias(last))
    joined = _marked(docs, spans, "left").withColumn(done, cut(docs["text"], F.col(first), F.col(last)))
    own = [F.col(f"{done}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    counts = [F.col(f"{done}.{n}").alias(name) for n, name in zip(("n_words", "n_removed"), names)]
    return joined.select(*own, *counts)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words lost by each document, and a digest of what is left."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove(docs, repeated_spans(docs))
    return cut.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM split)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY w) > 1 AS repeated FROM windows
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split
), marked AS (
  SELECT e.doc_id, e.i, e.word,
         coalesce(max(c.repeated) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM each e LEFT JOIN counted c ON e.doc_id = c.doc_id AND e.i = c.i
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""
