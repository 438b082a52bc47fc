"""Byte-level BPE, encoding and decoding, by the tokenizers library over Arrow batches.

A text's UTF-8 bytes are written as one printable character each (``byte_characters``);
the library merges these. Each distinct piece of text is given to the library once per
worker and its ids are remembered, up to ``REMEMBERED`` pieces. For decoding, the byte table
is reversed once for each token; the bytes of all tokens are joined before they are read
as text, so a character that is split over tokens is whole again.

Defined results: a NULL or empty text has no tokens; rows stay one to one whatever their
ids are (NULL, repeated); other columns of the input do not matter. A text of any length
is encoded whole, about ``PART`` characters at a time.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
REMEMBERED = 200_000
PART = 1 << 20
#: Rows decoded at a time.
ROWS = 500
#: White space as the pattern's ``\s`` knows it. A match never runs from another character into it.
SPACE = "".join(
    map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Codec:
    """The library's model of one rank file, with what encoding and decoding need around it."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import models

        characters = byte_characters()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.to_characters = dict(enumerate(characters))
        written = {token: "".join(characters[b] for b in token) for token in ranks}
        # any two tokens that make up a third may be merged, earlier ranks first
        merges = [
            (written[token[:i]], written[token[i:]])
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.model = models.BPE(
            vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True
        )
        self.pieces = regex.compile(pattern).findall
        to_bytes = {ord(c): b for b, c in enumerate(characters)}
        self.bytes_of = {r: written[t].translate(to_bytes).encode("latin-1") for t, r in ranks.items()}
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.numbers = {rank: str(rank) for rank in self.bytes_of}
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        parts = [np.frombuffer(self._part(part), np.int32) for part in _parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _part(self, text: str) -> bytes:
        pieces, known = self.pieces(text), self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for piece in dict.fromkeys(pieces):
                if piece not in known:
                    known[piece] = self._piece(piece)
            return b"".join([known[p] for p in pieces])

    def _piece(self, piece: str) -> bytes:
        characters = piece.encode().decode("latin-1").translate(self.to_characters)
        return np.array([t.id for t in self.model.tokenize(characters)], np.int32).tobytes()

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; tokens that split a character share it."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        ends = np.cumsum(self.lengths[ids])
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, dtype=np.int32) - 1
        return character[ends - self.lengths[ids]], character[ends - 1] + 1

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def _parts(text: str) -> list[str]:
    """The text cut where every match of the pattern ends: at white space after another character."""
    if len(text) <= PART:
        return [text]
    cut, parts, begin = re.compile(f"[^{SPACE}](?=[{SPACE}])"), [], 0
    while len(text) - begin > PART:
        found = cut.search(text, begin + PART)
        if found is None:
            break
        parts.append(text[begin : found.end()])
        begin = found.end()
    return [*parts, text[begin:]]


def _codec(path: str, pattern: str) -> Codec:
    return common.once(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def encode(
    docs: DataFrame,
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    offsets: bool = True,
) -> DataFrame:
    """``doc_id, ids`` and with ``offsets`` each token's ``starts, ends`` in characters."""
    path = path or public_tokenizers.path(VOCABULARY)
    kinds = "ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    held = docs.select("doc_id", "text")

    def run(stream):
        codec = _codec(path, pattern)

        def sent(batch, begin, arrays):
            own = batch.column("doc_id").slice(begin, len(arrays[0]))
            return pa.RecordBatch.from_arrays(
                [own, *(common.lists(pa.int32(), a) for a in arrays)], ["doc_id", "ids", "starts", "ends"][: 1 + len(arrays)]
            )

        for batch in stream:
            begin, size, arrays = 0, 0, [[] for _ in range(3 if offsets else 1)]
            for at, text in enumerate(common.texts(batch)):
                text = text or b""
                ids = codec.ids(text.decode())
                for array, values in zip(arrays, (ids, *codec.spans(text, ids)) if offsets else (ids,)):
                    array.append(values)
                size += len(ids)
                if size > 1 << 20:
                    yield sent(batch, begin, arrays)
                    begin, size, arrays = at + 1, 0, [[] for _ in arrays]
            if arrays[0]:
                yield sent(batch, begin, arrays)

    return held.mapInArrow(run, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, {kinds}")


def decode(tokens: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_text, decoded``: ids joined by commas, and their bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    held = tokens.select("doc_id", "ids")

    def run(stream):
        codec = _codec(path, pattern)
        for whole in stream:
            for begin in range(0, len(whole), ROWS):
                batch = whole.slice(begin, ROWS)
                yield _decoded(codec, batch.column("doc_id"), batch.column("ids"))

    return held.mapInArrow(run, _decoded_kinds(held))


def _decoded(codec: Codec, doc_ids: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
    counts, written, decoded = [], [], []
    for each in ids:
        own = each.values.to_numpy().tolist() if each.is_valid else []
        counts.append(len(own))
        written.append(",".join([codec.numbers[i] for i in own]))
        decoded.append(codec.decode(own))
    columns = [pa.array(counts, pa.int64()), ids, pa.array(written, pa.string()), pa.array(decoded, pa.binary())]
    return pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", "n_tokens", "ids", "ids_text", "decoded"])


def _decoded_kinds(held: DataFrame) -> str:
    kind = held.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, n_tokens long, ids array<int>, ids_text string, decoded binary"


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_text, decoded``: encoded and decoded again by one Python worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    held = docs.select("doc_id", "text")

    def run(stream):
        codec = _codec(path, pattern)
        for whole in stream:
            for begin in range(0, len(whole), ROWS):
                batch = whole.slice(begin, ROWS)
                ids = [codec.ids((text or b"").decode()) for text in common.texts(batch)]
                yield _decoded(codec, batch.column("doc_id"), common.lists(pa.int32(), ids))

    return held.mapInArrow(run, _decoded_kinds(held))


def digests(docs: DataFrame, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, the ``ids``."""
    return round_trip(docs).select(
        "doc_id",
        "n_tokens",
        *(["ids"] if ids else []),
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again, as digests."""
    return digests(common.table(spark, sf_dir, "documents"))
