"""Python helpers that run inside tasks: the splitter and the default embedder.

Both are row-local, so Spark partitions the documents and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd

from . import rules

try:  # made in a third of the time
    from _md5 import md5
except ImportError:
    from hashlib import md5


def split_text(
    text: str,
    size: int = rules.CHUNK_SIZE,
    overlap: int = rules.CHUNK_OVERLAP,
    separators: Sequence[str] = rules.CHUNK_SEPARATORS,
) -> list[str]:
    """Overlapping chunks of ``text``, cut at the coarsest separator that occurs.

    Pieces keep the separator they begin with. Short neighbours are packed into
    chunks of up to ``size`` characters; a piece of ``size`` or more is cut with
    the finer separators, and stays whole when none is left.
    """
    return list(_split(text, size, overlap, tuple(separators)))


def _split(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    separator, *finer = _cut_at(text, separators)
    bounds = _piece_bounds(text, separator)
    packed = 0
    for i, (start, end) in enumerate(pairwise(bounds)):
        if end - start < size:
            continue
        yield from _pack(text, bounds[packed : i + 1], size, overlap)
        packed = i + 1
        piece = text[start:end]
        if finer:
            yield from _split(piece, size, overlap, tuple(finer))
        else:
            # A piece no separator can cut keeps the one it begins with.
            yield piece
    yield from _pack(text, bounds[packed:], size, overlap)


def _cut_at(text: str, separators: tuple[str, ...]) -> tuple[str, ...]:
    """The first separator that occurs, and the finer ones after it."""
    for i, separator in enumerate(separators):
        if separator in text:
            return separators[i:]
    return ("",)


def _piece_bounds(text: str, separator: str) -> list[int]:
    """Where the pieces of ``text`` begin, and where the last one ends."""
    if not separator:
        return [0, len(text)] if text else [0]
    head, *tail = map(len, text.split(separator))
    bounds = list(accumulate((n + len(separator) for n in tail), initial=head))
    return [0, *bounds] if head else bounds


def _pack(text: str, bounds: Sequence[int], size: int, overlap: int) -> Iterator[str]:
    """Join consecutive short pieces greedily; carry up to ``overlap`` characters forward."""
    start, last = 0, len(bounds) - 1
    while start < last:
        end = bisect_right(bounds, bounds[start] + size) - 1
        chunk = text[bounds[start] : bounds[end]].strip()
        if chunk:
            yield chunk
        if end == last:
            return
        # What is carried must be short, and must leave room for the next piece.
        short = bisect_left(bounds, bounds[end] - overlap, start)
        roomy = bisect_left(bounds, bounds[end + 1] - size, start)
        start = min(end, max(short, roomy))


class _Buckets(dict):
    """Hash bucket of each word seen so far, started anew when it grows large."""

    def __init__(self, width: int, limit: int = 2**18):
        super().__init__()
        self.width, self.limit = width, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        bucket = int.from_bytes(md5(word.encode()).digest()[:4], "big") % self.width
        self[word] = bucket
        return bucket


class HashedWords:
    """Default embedder: word counts in ``width`` hash buckets, scaled to length one.

    A picklable factory, like every embedder: calling it gives the function that
    turns texts into a matrix, so a heavy model is loaded once per task.
    """

    # Runs of letters and digits.
    words = re.compile(r"[^\W_]+")

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self) -> Callable[[pd.Series], np.ndarray]:
        buckets = _Buckets(self.width)

        def encode(texts: pd.Series) -> np.ndarray:
            vectors = np.zeros((len(texts), self.width))
            # some rows at a time, all of whose words are counted at once
            step = max(1, 2**20 // self.width)
            for start in range(0, len(texts), step):
                found = [self.words.findall((text or "").lower()) for text in texts[start : start + step]]
                row = np.repeat(np.arange(len(found)), list(map(len, found)))
                bucket = np.fromiter((buckets[word] for words in found for word in words), np.int64, len(row))
                counts = np.bincount(row * self.width + bucket, minlength=len(found) * self.width)
                vectors[start : start + step] = counts.reshape(len(found), self.width)
            norms = np.sqrt((vectors**2).sum(1, keepdims=True))
            return np.divide(vectors, norms, out=vectors, where=norms > 0)

        return encode
