"""Language identification by string kernels.

Two texts are as alike as the character n-grams they share: for each length n the count of
common n-grams over the geometric mean of both counts (presence, not frequency), averaged
over n (a blended spectrum). Nyström: each text is described by its kernel values with a
few landmark texts; on these, ridge regression fits one score per language against the
rest. Scoring a batch is two matrix products: presence by landmarks, kernel by weights.

The model is fitted on a bounded sample: ``SAMPLE_ROWS`` labelled rows in all, spread
evenly over the languages (one row each, the most frequent first, where there are more languages
than that), taken by a hash of id and text among distinct rows of 1 to ``SAMPLE_CHARACTERS``
characters, whole. Landmarks need not be of every language. Every document is scored whole.

A text is accepted if enough of its distinct 3-grams are familiar: known from half of the sample's
rows of the language predicted. Enough is ``LEAST_FAMILIAR``, or what all but one in a hundred of the
other half's rows reach where that is less, so a language with few rows loses no more. The rule looks
at one language alone, so it does not depend on how many there are.

Defined results: a NULL text or one without a letter is ``und`` with score 0; so is every
text when there is nothing to learn from. Rows with a NULL id, text or language teach
nothing. Rows stay one to one, repeated or not; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDERS = (1, 2, 3)
SAMPLE_ROWS = 2000
SAMPLE_CHARACTERS = 20_000
#: Landmarks spread evenly over the languages, two of each at least while that makes no more than the second number.
LANDMARKS, MOST_LANDMARKS = 128, 512
RIDGE = 1e-3
FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"
#: A text with a smaller share of familiar 3-grams is taken for none of the learned languages.
LEAST_FAMILIAR = 0.5
#: Documents scored by one matrix product.
BLOCK = 64

_OTHERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """Lower-cased letters with their marks, anything between them as one space; empty without a letter."""
    kept = _OTHERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} " if any(map(str.isalpha, kept)) else ""


def grams(text: str) -> list[np.ndarray]:
    """Distinct n-grams of each order, sorted, 21 bits a character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    found, codes = [], points
    for n in ORDERS:
        if n > 1:
            codes = (codes[:-1] << 21) | points[n - 1 :]
        found.append(np.unique(codes))
    return found


@dataclass
class Model:
    """``grams[n]`` are the landmarks' n-grams, ``present[n]`` who has them, scaled.

    ``familiar`` holds a language's 3-grams, ``least`` the share of a text's that must be among them.
    """

    languages: list[str]
    grams: list[np.ndarray]
    present: list[np.ndarray]
    weights: np.ndarray
    familiar: list[np.ndarray] = field(default_factory=list)
    least: list[float] = field(default_factory=list)

    def familiarity(self, own: list[np.ndarray], language: int) -> float:
        """The share of a text's distinct 3-grams that are the language's; 1 for a text of fewer than three characters."""
        return share_known(own[-1], self.familiar[language])

    def kernel(self, block: list[list[np.ndarray]]) -> np.ndarray:
        """Texts by landmarks, with a last column of ones."""
        total = np.ones((len(block), self.present[0].shape[1] + 1), np.float32)
        total[:, :-1] = 0
        for n, (known, landmarks) in enumerate(zip(self.grams, self.present)):
            has = np.zeros((len(block), len(known)), np.float32)
            for row, own in zip(has, block):
                at = np.searchsorted(known, own[n])
                at[at == len(known)] = 0
                row[at[known[at] == own[n]]] = 1 / np.sqrt(max(len(own[n]), 1)) / len(ORDERS)
            total[:, :-1] += has @ landmarks
        return total

    def score(self, block: list[list[np.ndarray]]) -> np.ndarray:
        return np.clip((self.kernel(block) @ self.weights + 1) / 2, 0, 1)


def share_known(own: np.ndarray, known: np.ndarray) -> float:
    """The share of ``own`` in ``known``, both sorted; 1 if there is nothing to compare."""
    if not len(own):
        return 1.0
    if not len(known):
        return 0.0
    return float((known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own).mean())


def _familiar(held: list[list[np.ndarray]]) -> tuple[np.ndarray, float]:
    """A language's 3-grams from every other of its texts, and the share that nearly all the rest reach."""
    known = np.unique(np.concatenate([g[-1] for g in held[::2]]))
    reached = [share_known(g[-1], known) for g in held[1::2]]
    return known, min(LEAST_FAMILIAR, float(np.quantile(reached, 0.01, method="lower"))) if reached else LEAST_FAMILIAR


def train(rows: list[tuple[str, str]]) -> Model | None:
    """A model from ``(lang, text)`` rows; None without a usable row."""
    held = [(lang, grams(kept)) for lang, text in rows if (kept := letters(text))]
    if not held:
        return None
    languages = sorted({lang for lang, _ in held})
    share = max(2, LANDMARKS // len(languages))
    spoken: dict[str, list] = {lang: [] for lang in languages}
    for lang, found in held:
        spoken[lang].append(found)
    marks = [g for lang in languages for g in spoken[lang][:share]]
    marks = marks[:: -(-len(marks) // MOST_LANDMARKS)]
    known = [np.unique(np.concatenate([g[n] for g in marks])) for n in range(len(ORDERS))]
    present = []
    for n, codes in enumerate(known):
        matrix = np.zeros((len(codes), len(marks)), np.float32)
        for m, own in enumerate(marks):
            matrix[np.searchsorted(codes, own[n]), m] = 1 / np.sqrt(len(own[n]))
        present.append(matrix)
    model = Model(languages, known, present, np.zeros((len(marks) + 1, len(languages)), np.float32))
    kernel = lambda found: np.concatenate(
        [model.kernel(found[i : i + BLOCK]) for i in range(0, len(found), BLOCK)]
    ).astype(np.float64)
    seen, among = kernel([g for _, g in held]), np.zeros((len(marks) + 1,) * 2)
    among[:-1, :-1] = kernel(marks)[:, :-1]
    target = np.array([[1.0 if lang == l else -1.0 for l in languages] for lang, _ in held])
    normal = seen.T @ seen + RIDGE * len(held) * among + 1e-6 * len(held) * np.eye(len(among))
    model.weights = np.linalg.solve(normal, seen.T @ target).astype(np.float32)
    for language in languages:
        known, least = _familiar(spoken[language])
        model.familiar.append(known)
        model.least.append(least)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the id's remainder is the held-out one; a NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """Learn from the ``text`` and ``lang`` of rows that are not held out."""
    size = F.length("text")
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & size.between(1, SAMPLE_CHARACTERS)
    )
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()
    if not counts:
        return None
    share, scale = SAMPLE_ROWS // len(counts), 1 << 40
    # more than enough by chance, so that the hash's threshold leaves no language short
    enough = 1.2 * share + 4 * share**0.5 + 8
    limits = [(r["lang"], int(scale * min(1.0, enough / r["count"]))) for r in counts]
    limits = F.broadcast(usable.sparkSession.createDataFrame(limits, "lang string, most long"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale))
    sample = usable.withColumn("place", place).join(limits, "lang").where("place <= most").select("lang", "text", "place").distinct()
    # by hash, so that a retry chooses no other rows
    order = Window.partitionBy("lang").orderBy("place", "text")
    rows = sample.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= share).orderBy("place", "lang", "text").collect()
    return train([(r["lang"], r["text"]) for r in rows])


def _judged(batch: pa.RecordBatch, model: Model | None, column: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text of a batch, and whether it is accepted, ``BLOCK`` texts at a time."""
    names, scores, stays = [UNDETERMINED] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), bool)
    at: list[int] = []
    block: list[list[np.ndarray]] = []

    def flush():
        for place, grammed, own in zip(at, block, model.score(block)):
            best = own.argmax()
            names[place], scores[place] = model.languages[best], own[best]
            stays[place] = model.familiarity(grammed, best) >= model.least[best]
        at.clear()
        block.clear()

    for place, text in enumerate(common.texts(batch, column)):
        kept = letters(text.decode()) if text and model else ""
        if kept:
            at.append(place)
            block.append(grams(kept))
            if len(block) == BLOCK:
                flush()
    if block:
        flush()
    return names, scores, stays


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` from the text alone."""
    held = docs.select("doc_id", "text")

    def run(stream):
        for batch in stream:
            names, scores, _ = _judged(batch, model)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` whose text is familiar enough in the language predicted for it."""
    # columns by place while in Arrow: names may hold dots
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"

    def run(stream):
        for batch in stream:
            yield batch.filter(pa.array(_judged(batch, model, text)[2], pa.bool_()))

    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
