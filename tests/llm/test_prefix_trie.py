"""The prefix trie against a trie of plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as driver
from noteflow.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    found = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        if conv is not None:
            found.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    return {conv: [t[2] for t in sorted(turns)] for conv, turns in found.items()}


def rebuilt(found):
    out = {}
    for conv, turns in found.items():
        h = zlib.crc32(str(conv).encode()) % 4
        first = conv - int(np.fmod(conv, 20))
        out[conv] = found.get(first, [])[:h] + turns[h:]
    return out


def brute(found):
    nodes = {}
    for conv, turns in found.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def sums(path):
        own = (len(nodes[path]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
        below = [sums(child) for child in children.get(path, [])]
        return sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)

    out = []
    for path, convs in nodes.items():
        ends = sorted(c for c in convs if len(found[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(convs), len(path), parent, len(convs), len(children.get(path, [])), *sums(path), digest))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def answers(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def drawn(seed, convs, alphabet, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, turn, draw.choice(["user", "assistant"][: 1 + seed % 2]), draw.choice(alphabet)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, alphabet, longest, parts", [
    (1, 60, ["a b", "c", ""], 6, 7), (2, 300, ["one two three"], 4, 5), (3, 150, ["x", "y y"], 12, 1), (4, 40, list("abcdefgh"), 3, 40),
])
def test_trie(spark, seed, convs, alphabet, longest, parts):
    rows = drawn(seed, convs, alphabet, longest)
    found = prefix_trie.rebuilt(prefix_trie.sequences(frame(spark, rows)))
    assert answers(prefix_trie.trie(found, parts=parts)) == brute(rebuilt(ordered(rows)))


def test_copies_of_one_conversation_spread_over_parts(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)] + [(1000, 0, "user", "turn 0")]
    found = prefix_trie.sequences(frame(spark, rows))
    assert answers(prefix_trie.trie(found, parts=9)) == brute(ordered(rows))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    rows = [
        (None, 0, "user", "lost"), (1, None, None, "first of one"), (1, 0, "user", None), (1, 0, "user", None), (1, 5, "assistant", "a  b\tc d"),
        (20, 0, "user", "shared"), (20, 1, "assistant", "start"), (20, 2, "user", "again"), (20, 3, "user", "tail"),
        (21, 7, "x", "own"), (22, 1, "a", "b"), (23, -4, "user", "only"), (24, 1, "user", "w " * 50_000), (25, 1, "", "1:"), (26, 1, "1:", ""),
        (-5, 1, "user", "negative"), (-40, 1, "user", "n"), (0, 1, "user", "n"), (2**40, 3, "user", "far"), (41, 0, "user", "absent base"),
    ]
    rows += [(c, 0, "user", "shared") for c in range(27, 40)] + [(60, t, "user", f"long {t}") for t in range(300)] + [(61, t, "user", f"long {t}") for t in range(300)]
    folder = str(tmp_path_factory.mktemp("conversations"))
    kind = "conv_id long, turn long, role string, text string, turns string, depth string, part string, path string"
    spark.createDataFrame([(*r, "t", "d", "p", None) for r in rows], kind).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def test_awkward_table(spark, awkward):
    folder, rows = awkward
    assert answers(driver.queries()["op13_prefix_trie"](spark, folder)) == brute(rebuilt(ordered(rows)))


def test_query_on_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(driver.queries()["op13_prefix_trie"](spark, sf_dir)) == brute(rebuilt(ordered(rows)))


def test_nodes_name_their_last_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a")]
    found = prefix_trie.sequences(frame(spark, rows))
    named = {(r.conv_id, r.depth): r.digest for r in prefix_trie.last_turns(prefix_trie.trie(found, 2), found).collect()}
    assert named == {(1, 1): hashlib.md5(b"4:usera").hexdigest(), (1, 2): hashlib.md5(b"4:userb").hexdigest()}


def test_extents_of_every_prefix(spark):
    draw = random.Random(5)
    paths = sorted(b"".join(bytes([draw.randint(0, 1)]) * 16 for _ in range(draw.randint(0, 5))) for _ in range(70))
    rows = prefix_trie.sparse_table(prefix_trie.common_prefixes(paths))
    for at, path in enumerate(paths):
        for depth in range(len(path) // 16 + 1):
            members = [i for i, p in enumerate(paths) if p[: 16 * depth] == path[: 16 * depth]]
            one = np.array([at]), np.array([depth])
            assert (prefix_trie.left_extent(rows, *one)[0], prefix_trie.right_extent(rows, *one)[0]) == (members[0], members[-1])
