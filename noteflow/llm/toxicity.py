"""Toxic spans by a linear-chain conditional random field.

Learning, from a bounded sample (``SAMPLE_ROWS`` labelled documents of each class, whole,
of ``SAMPLE_CHARACTERS`` characters or fewer, taken by a hash of their id): words and word
beginnings that are far more frequent in toxic documents than in others label the tokens of
toxic documents; on these labelled tokens the field is trained (features of a token: itself
and its beginnings; two states with transitions). A logistic curve over what the marginals
add up to turns them into a document's score.

Tagging: forward-backward over the whole text gives each token's probability of being
toxic. Between tokens with a learned feature all factors are equal, so a gap is one power of a
two-by-two matrix; this is exact and costs as much as there are such tokens.

Defined results: a NULL or empty text has no spans and the score of a text without any
evidence. Rows that are NULL in id, text or label teach nothing. With no toxic or no other
row to learn from, all scores are the share of toxic rows, or 0. Rows stay one to one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 2000
SAMPLE_CHARACTERS = 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Beginnings of words that are features, in characters.
BEGINNINGS = (4, 5, 6, 7)
#: A feature is evidence from such log odds on, if chance would hardly make it so frequent.
LEAST_ODDS, CHANCE = 2.5, 1e-7
#: Segments of labelled lines for training, and their longest.
SEGMENTS, SEGMENT = 4000, 48
REMEMBERED = 1_000_000

_TOKENS = re.compile(r"[^\W\d_]+")


def features(token: str) -> list[str]:
    word = token.lower()
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    weights: dict[str, float]  # of evidence features, for the toxic state
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log factors, from row to column
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    known: dict[str, float] = field(default_factory=dict)

    def emission(self, token: str) -> float:
        """Sum of the token's weights; NaN without a learned feature."""
        found = [self.weights[f] for f in features(token) if f in self.weights]
        return sum(found) if found else math.nan

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[t] for t in tokens])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            known.update((t, self.emission(t)) for t in set(tokens) if t not in known)
            return np.array([known[t] for t in tokens])

    def marginals(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens with a learned feature, and their probabilities."""
        given = self.emissions(tokens)
        sites = np.flatnonzero(~np.isnan(given))
        if not len(sites):
            return sites, np.zeros(0)
        move, plain = np.exp(self.moves), np.array([1.0, math.exp(self.bias)])
        gap = _Powers(move * plain[None, :])  # a step onto a token without features
        own = np.stack([np.ones(len(sites)), np.exp(np.clip(given[sites] + self.bias, -50, 50))], 1)
        forward, ahead = np.zeros((len(sites), 2)), np.ones(2) / 2
        skips = np.diff(sites, prepend=-1) - 1
        for k in range(len(sites)):
            if k == 0:
                before = ahead * plain @ gap(skips[0] - 1) @ move if skips[0] else ahead
            else:
                before = forward[k - 1] @ gap(skips[k]) @ move
            now = before * own[k]
            forward[k] = now / now.sum()
        back = gap(len(tokens) - 1 - sites[-1]).sum(1)
        chance = np.zeros(len(sites))
        for k in range(len(sites) - 1, -1, -1):
            both = forward[k] * back
            chance[k] = both[1] / both.sum()
            if k:
                back = gap(skips[k]) @ move @ (own[k] * back)
                back /= back.sum()
        return sites, chance

    def summary(self, chance: np.ndarray) -> np.ndarray:
        return np.array([1.0, math.log1p(chance.sum()), chance.max(initial=0.0)])

    def score(self, chance: np.ndarray) -> float:
        return 1 / (1 + math.exp(-float(np.clip(self.summary(chance) @ self.curve, -50, 50))))


class _Powers:
    """Powers of a positive two-by-two matrix, scaled by its largest eigenvalue."""

    def __init__(self, matrix: np.ndarray):
        values, self.vectors = np.linalg.eig(matrix)
        self.values, self.inverse = (values / np.abs(values).max()).real, np.linalg.inv(self.vectors).real
        self.vectors = self.vectors.real

    def __call__(self, n: int) -> np.ndarray:
        return np.maximum((self.vectors * self.values**n) @ self.inverse, 1e-300) if n > 0 else np.eye(2)


def train(rows: list[tuple[int, str]], shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from ``(toxic, text)``; ``shares`` are the parts of all rows that each class's rows are."""
    tokens = [(label, _TOKENS.findall(text)) for label, text in rows]
    sizes = Counter(label for label, _ in tokens)
    if not sizes[0] or not sizes[1]:
        rate = sizes[1] / len(tokens) if tokens else 0.0
        return Model({}, curve=np.array([math.log((rate + 1e-9) / (1 - rate + 1e-9)), 0.0, 0.0]))
    evidence = _evidence(tokens, sizes)
    index = {f: i + 1 for i, f in enumerate(sorted(evidence))}
    model = _field(tokens, evidence, index)
    found = np.array([model.summary(model.marginals(t)[1]) for _, t in tokens])
    target = np.array([label for label, _ in tokens], float)
    weight = np.array([1 / shares[label] for label, _ in tokens])
    model.curve = _logistic(found, target, weight / weight.mean())
    model.known = {}
    return model


def _evidence(tokens, sizes) -> dict[str, float]:
    """Log odds of the features that tell toxic documents from others."""
    counts = (Counter(), Counter())
    for label, own in tokens:
        counts[label].update({f for t in set(own) for f in features(t)})
    odds = {}
    for f, n in counts[1].items():
        expected = (counts[0][f] + 0.5) / (sizes[0] + 1) * sizes[1]
        value = math.log((n + 0.1) / (expected + 0.1))
        if value >= LEAST_ODDS and n * math.log(expected) - expected - math.lgamma(n + 1) <= math.log(CHANCE):
            odds[f] = value
    return odds


def _field(tokens, evidence, index) -> Model:
    """The field, by gradient steps on the conditional likelihood of labelled segments."""
    segments = []
    for label, own in tokens:
        for at in range(0, len(own), SEGMENT):
            part = own[at : at + SEGMENT]
            found = [[index[f] for f in features(t) if f in index] for t in part]
            if any(found) or at == 0:
                segments.append((found, [int(bool(label and f)) for f in found]))
    segments = segments[:: max(1, len(segments) // SEGMENTS)]
    width = len(BEGINNINGS) + 1
    ids = np.zeros((len(segments), SEGMENT, width), np.int64)
    truth = np.zeros((len(segments), SEGMENT), np.int64)
    held = np.zeros((len(segments), SEGMENT), bool)
    for s, (found, labels) in enumerate(segments):
        held[s, : len(found)], truth[s, : len(found)] = True, labels
        for t, own in enumerate(found):
            ids[s, t, : len(own)] = own
    weights, bias, moves = np.zeros(len(index) + 1), -2.0, np.zeros((2, 2))
    flat = [np.zeros(len(weights) + 5), np.zeros(len(weights) + 5)]
    after = held[:, 1:]
    for step in range(1, 61):
        chance, pairs = _expectations(weights[ids].sum(2) + bias, moves, held)
        wrong = (chance - truth) * held
        gradient = np.bincount(ids.ravel(), np.repeat(wrong.ravel(), width), len(weights)) + 0.05 * weights
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[:, :-1][after], truth[:, 1:][after]), 1)
        slope = np.concatenate([gradient, [wrong.sum()], (pairs - seen).ravel() + 0.05 * moves.ravel()])
        flat[0] = 0.9 * flat[0] + 0.1 * slope
        flat[1] = 0.99 * flat[1] + 0.01 * slope**2
        move = 0.15 * flat[0] / (1 - 0.9**step) / (np.sqrt(flat[1] / (1 - 0.99**step)) + 1e-8)
        weights -= move[: len(weights)]
        bias -= move[len(weights)]
        moves -= move[len(weights) + 1 :].reshape(2, 2)
        weights[0] = 0.0
    return Model({f: float(weights[i]) for f, i in index.items()}, float(bias), moves)


def _expectations(scores: np.ndarray, moves: np.ndarray, held: np.ndarray):
    """Each token's probability of the toxic state, and the expected count of each move."""
    own = np.stack([np.zeros_like(scores), scores], 2)
    n, length = scores.shape
    forward, back = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    forward[:, 0] = own[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + own[:, t]
        forward[:, t] = np.where(held[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(moves + (own[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where(held[:, t + 1, None], step, 0.0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    chance = np.exp(np.minimum(forward[..., 1] + back[..., 1] - total[:, None], 0)) * held
    joint = forward[:, :-1, :, None] + moves + (own + back)[:, 1:, None, :] - total[:, None, None, None]
    pairs = (np.exp(np.minimum(joint, 0)) * held[:, 1:, None, None]).sum((0, 1))
    return chance, pairs


def _logistic(found: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    curve = np.zeros(found.shape[1])
    for _ in range(50):
        guess = 1 / (1 + np.exp(-np.clip(found @ curve, -30, 30)))
        slope = found.T @ (weight * (guess - target)) + 0.01 * curve
        bend = (found * (weight * np.maximum(guess * (1 - guess), 1e-6))[:, None]).T @ found
        curve -= np.clip(np.linalg.solve(bend + 0.01 * np.eye(len(curve)), slope), -2, 2)
    return curve


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the id's remainder is the held-out one; a NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows that are not held out."""
    given = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    counts = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    scale = 1 << 40
    part = {k: min(1.0, SAMPLE_ROWS / max(counts.get(k, 0), 1)) for k in (0, 1)}
    limit = F.when(F.col("toxic") == 1, F.lit(int(scale * part[1]))).otherwise(F.lit(int(scale * part[0])))
    sample = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) <= limit)
    # by hash, so that repeated ids or a retry choose no other rows
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(3 * SAMPLE_ROWS)
    # bounded by the sample, so the documents stay where they are
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARACTERS))
    rows = texts.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(4 * SAMPLE_ROWS).collect()
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows)
    return train([(toxic, text) for _, toxic, text in rows], (part[0], part[1]))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, spans``: toxic tokens as ``begin, end`` (characters) and ``chance``."""
    held = docs.select("doc_id", "text")
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])

    def run(stream):
        def rows(batch):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                tokens = _TOKENS.findall(text)
                sites, chance = model.marginals(tokens) if tokens else (np.zeros(0, int), np.zeros(0))
                toxic = {int(s): float(c) for s, c in zip(sites, chance) if c >= 0.5}
                spans = []
                if toxic:
                    for at, match in enumerate(_TOKENS.finditer(text)):
                        if at in toxic:
                            spans.append({"begin": match.start(), "end": match.end(), "chance": toxic[at]})
                yield doc, model.score(chance), spans

        for batch in stream:
            schema = pa.schema([batch.schema.field("doc_id"), ("score", pa.float64()), ("spans", pa.list_(span))])
            yield from common.batches(rows(batch), schema, lambda r: 24 + 16 * len(r[2]))

    kind = held.schema["doc_id"].dataType.simpleString()
    spans = "spans array<struct<begin: int, end: int, chance: double>>"
    return held.mapInArrow(run, f"doc_id {kind}, score double, {spans}")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text, learned from the labels that are not held out."""
    docs, labels = (common.table(spark, sf_dir, n) for n in ("documents", "labels"))
    tagged = tag(docs, fit(docs, labels))
    return tagged.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )
