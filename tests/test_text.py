"""The splitter and the default embedder."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from noteflow.functions.text import HashedWords, split_text
from noteflow.operators import retrieval


def test_short_text_is_one_chunk():
    assert split_text("  one two\n\nthree  ") == ["one two\n\nthree"]
    assert split_text("") == []
    assert split_text(" \n\n ") == []


def test_coarsest_separator_first():
    first, second = "a" * 300, "b" * 300
    assert split_text(f"{first}\n\n{second}") == [first, second]
    assert split_text(f"{first}\n{second}") == [first, second]
    assert split_text(f"{first} {second}") == [first, second]


def test_overlap_is_carried_forward():
    words = [f"w{i:03d}" for i in range(250)]
    chunks = split_text(" ".join(words))
    assert all(len(c) <= 500 for c in chunks)
    for left, right in zip(chunks, chunks[1:]):
        head = right[: right.index(left[-4:]) + 4]
        assert left.endswith(head)
        assert len(head) <= 50


def test_pieces_that_are_too_long_to_carry():
    first, second, third = "a" * 260, "b" * 200, "c" * 300
    assert split_text("\n".join([first, second, third])) == [f"{first}\n{second}", third]


def test_exact_size_piece_is_not_packed_with_its_neighbours():
    piece = "x" * 249 + " " + "y" * 250
    assert split_text(f"{piece}\n\nend") == [piece, "end"]
    assert split_text(f"{piece[:-1]}\n\nend") == [piece[:-1], "end"]
    assert split_text(f"{piece}y\n\nend") == ["x" * 249, "y" * 251, "end"]


def test_token_over_the_size_stays_whole():
    token = "t" * 600
    chunks = split_text(f"one two\n\nthree {token} four\n\nfive")
    assert [c.strip() for c in chunks] == ["one two", "three", token, "four", "five"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_splitter_invariants(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(c.strip() for c in chunks)
    # Only a piece without any separator inside may reach past the size.
    assert all(len(c) <= size or not re.search(r"[ \n]", c.strip()) for c in chunks)
    # Chunks come in order and leave no visible character out.
    covered = set()
    for chunk in chunks:
        core = chunk.strip()
        starts = [m.start() for m in re.finditer(f"(?={re.escape(core)})", text)]
        assert starts
        for start in starts:
            covered.update(range(start, start + len(core)))
    assert all(c in " \n" or i in covered for i, c in enumerate(text))


def test_chunk_table(spark):
    docs = spark.createDataFrame([("d", "a" * 300 + "\n\n" + "b" * 300), ("e", ""), ("f", None)],
                                 "doc_id string, text string")
    rows = sorted(tuple(r) for r in retrieval.chunk_documents(docs).collect())
    assert rows == [("d:0", "d", 0, "a" * 300), ("d:1", "d", 1, "b" * 300)]


def test_hashed_words():
    encode = HashedWords(16)()
    vectors = encode(pd.Series(["Sepsis, sepsis risk!", "", None]))
    expected = np.zeros(16)
    for word in ("sepsis", "sepsis", "risk"):
        expected[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
    assert np.allclose(vectors[0], expected / np.linalg.norm(expected))
    assert not vectors[1:].any()


def test_own_embedder(spark):
    def lengths():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])

    df = spark.createDataFrame([("abc",), (None,)], "text string")
    rows = retrieval.embed(df, "text", lengths).collect()
    assert [r.embedding for r in rows] == [[3.0, 1.0], [0.0, 1.0]]
