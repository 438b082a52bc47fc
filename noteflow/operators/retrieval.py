"""Chunks, embeddings and context of a question, each as a DataFrame step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import split_text
from ..sources.work import written
from . import neighbours, vector_index

#: Buckets of the default embedder's words.
WIDTH = 64

#: Hits (three short columns each) that may be broadcast: three for each of 4,096 questions, and some more.
BROADCAST_HITS = 16_384


def chunk_documents(
    documents: DataFrame,
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
    separators=rules.CHUNK_SEPARATORS,
) -> DataFrame:
    """``vec_id, doc_id, chunk_ix, chunk`` of ``documents(doc_id, text)``; row-local."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: split_text(text or "", size, overlap, separators))

    chunks = documents.select("doc_id", F.posexplode(split("text")).alias("chunk_ix", "chunk"))
    vec_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_ix").cast("string"))
    return chunks.select(vec_id.alias("vec_id"), "doc_id", "chunk_ix", "chunk")


def word_counts(df: DataFrame, text: str, width: int = WIDTH, out: str = "embedding") -> DataFrame:
    """Add ``out``, a struct of ``indices`` and ``values``: the hashed bag of words of column ``text``, scaled to length one.

    Column expressions only. A word's bucket is the first 32 bits of its MD5 modulo ``width``; indices come in order
    and only buckets with a word are held, so ``width`` may be large. A text without words has empty lists.
    """
    own = "_words"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    sorted_, first, count = f"{own}_sorted", f"{own}_first", f"{own}_count"
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")
    # columns of their own, since a lambda evaluates what it holds for each element
    held = df.withColumn(sorted_, F.array_sort(F.transform(words(F.coalesce(F.col(text), F.lit(""))), bucket)))
    held = held.withColumn(own, F.array_distinct(sorted_))
    # where each bucket begins among the sorted ones: what lies between is its count
    held = held.withColumn(first, F.transform(own, lambda b: F.array_position(F.col(sorted_), b)))
    after = lambda i: F.coalesce(F.get(F.col(first), i + 1), F.size(sorted_) + 1)
    held = held.withColumn(count, F.transform(first, lambda at, i: after(i) - at))
    norm = F.sqrt(F.aggregate(count, F.lit(0).cast("long"), lambda s, n: s + n * n).cast("double"))
    held = held.withColumn(first, norm)
    values = F.transform(count, lambda n: n.cast("double") / F.col(first))
    return held.select(*[F.col(f"`{c}`") for c in df.columns], F.struct(F.col(own).alias("indices"), values.alias("values")).alias(out))


def embed(df: DataFrame, text: str, embedder=None, out: str = "embedding", width: int = WIDTH) -> DataFrame:
    """Add the vector of column ``text``.

    By default the hashed bag of words of :func:`word_counts` as ``width`` numbers, without Python. ``embedder`` is a
    picklable factory instead: called once per task, it returns a
    function from a pandas Series of texts to a matrix, one row per text.
    """
    if embedder is None:
        own = "_bag"
        while any(c.startswith(own) for c in df.columns):
            own += "_"
        indices, values = f"{own}_indices", f"{own}_values"
        held = word_counts(df, text, width, own)
        # through inline, else the optimizer copies the lists into the lambda and makes them anew for every bucket
        once = F.inline(F.array(F.col(own))).alias(indices, values)
        held = held.select(*[F.col(f"`{c}`") for c in df.columns], once)
        place = lambda b: F.array_position(F.col(indices), b).cast("int")
        dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.coalesce(F.get(F.col(values), place(b) - 1), F.lit(0.0)))
        dense = dense.cast("array<double>")  # elements that may be NULL, as in the vector table
        return held.select(*[F.col(f"`{c}`") for c in df.columns if c != out], dense.alias(out))

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for texts in batches:
            yield pd.Series(list(model(texts)), index=texts.index)

    # Marked so that the optimizer never runs a costly model a second time in a
    # filter it derives from the vector.
    once = encode.asNondeterministic()
    return df.withColumn(out, once(F.coalesce(F.col(text), F.lit(""))))


def vector_table(documents: DataFrame, embedder=None) -> DataFrame:
    """``vec_id, chunk, embedding`` of every chunk, ready to be written once."""
    return embed(chunk_documents(documents), "chunk", embedder).select("vec_id", "chunk", "embedding")


def context(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``context`` to each question: its hit chunks, best first, a blank line apart.

    A question without hits (an empty one, say) gets an empty context. ``hits`` are
    written and counted: up to ``BROADCAST_HITS`` of them travel to the chunks, so that
    the chunk table stays where it is. More of them meet it in a plain shuffle of both
    sides, which adaptive execution can split where many questions hit one chunk.
    """
    hits = written(hits.select("query_id", "vec_id", "rank"), "hits")
    # many hits are few bytes on disk, by which the planner would send them all the same
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits.hint("merge")
    texts = chunks.select("vec_id", "chunk").join(hits, "vec_id")
    joined = texts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("best")
    )
    joined = joined.select(
        "query_id", F.array_join(F.transform("best", lambda hit: hit["chunk"]), "\n\n").alias("context")
    )
    found = F.coalesce("context", F.lit(""))
    return questions.join(joined, "query_id", "left").withColumn("context", found)


def retrieve_context(
    questions: DataFrame, vectors: DataFrame, k: int = rules.NEIGHBOURS, embedder=None
) -> DataFrame:
    """Add ``context`` to ``questions(query_id, text)`` from a vector table."""
    asked = questions.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    # the search reads its questions more than once, the model shall not
    wanted = written(embed(asked.select("query_id", "text"), "text", embedder), "questions")
    hits = neighbours.nearest(wanted, vectors, k)
    return context(questions, hits, vectors)


def retrieve_from_index(questions: DataFrame, path: str, k: int = rules.NEIGHBOURS, embedder=None) -> DataFrame:
    """Add ``context`` to ``questions(query_id, text)`` from a kept index of ``vec_id, chunk, embedding``.

    Nothing is placed and only the cells that a question may have a neighbour in are read for the search.
    """
    asked = questions.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    wanted = written(embed(asked.select("query_id", "text"), "text", embedder), "questions")
    hits = vector_index.search(wanted.select("query_id", "embedding"), path, k)
    return context(questions, hits, vector_index.vectors(questions.sparkSession, path))


# ---- keywords --------------------------------------------------------------

def words(text: str):
    """Array of the lower-cased runs of letters and digits of column ``text``."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda word: word != "")


def keywords(questions: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, keyword, score, rank``: the ``k`` terms of highest tf-idf per question.

    Ids are unique. Document frequencies come from each question's distinct
    words and are folded before they are shuffled. They are grouped by a hash
    beside the word, so that the join shuffles them once more: with a plain
    shuffle on both sides adaptive execution can split a word that occurs in a
    large share of all questions.
    """
    terms = (
        questions.select("query_id", F.explode(words("text")).alias("keyword"))
        .groupBy("query_id", "keyword")
        .agg(F.count("*").alias("tf"))
    )
    spread = (
        questions.select(F.explode(F.array_distinct(words("text"))).alias("keyword"))
        .groupBy("keyword", F.xxhash64("keyword"))
        .agg(F.count("*").alias("df"))
        .select("keyword", "df")
    )
    total = questions.agg(F.count("*").alias("n")).scalar()
    score = F.round(F.col("tf") * F.log(total / F.col("df")), 6)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "keyword")
    return (
        terms.join(spread, "keyword")
        .select("query_id", "keyword", score.alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )
