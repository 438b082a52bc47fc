"""Prefix trie of conversations, from sorted longest common prefixes.

A turn is the 16-byte digest of its role and text, a conversation the string of its turns'
digests. Conversations are sorted by that string and then by id, and cut into parts by range,
so that copies of one conversation spread over parts like any other rows. In a part:

* LCP[i] is the number of turns that conversations i - 1 and i share at their start, and a
  sparse table answers the minimum of any range of them in two lookups;
* candidate prefixes are the shared starts (i, LCP[i]) and the whole conversations. Each one
  searches its extents to the left and to the right by itself, halving steps over the table:
  the conversations between are its members. No stack, no order among the candidates;
* depths that no conversation branches off at have the members of the candidate below them.

Nodes in order of (first member, depth) have their subtrees in one run, so sums over subtrees
are differences of running sums. A prefix that goes on in a neighbouring part is *open*; there
are as many in a part as its edge conversations share turns with their neighbours. Every figure
of an open node is a sum or minimum over parts: a node counts as a child, and its words once,
where it begins, and as a leaf where it ends. So open nodes are folded by key, and nothing
but them leaves its part.

Defined results: rows without a conv_id belong to no conversation; a NULL turn comes first; turns
of equal number come in the order of their digests; a NULL role or text is empty; repeated rows
are turns like any other. No conversation, no node. One conversation must fit a task (16 bytes a
turn), and the digest over the members that end at one node is taken in one task, as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written
from . import common

#: Bytes of a turn's digest.
DIGEST = 16
#: Bytes of digests that a part holds, on average.
PART_BYTES = 16 << 20
#: Conversations of ``op13_prefix_trie`` come in families of so many, the first of which lends the others its start.
FAMILY = 20
SPACE = r"[^\x20\x09-\x0D]+"

NODE = (
    "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_n decimal(38,0), saved_w decimal(38,0), "
    "ends string, key string, parent_key string, parent_conv_id long, opens boolean, part int"
)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: per conversation its turns in order, each with ``digest`` (hex) and ``words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(SPACE))
    of = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), words.alias("words")).alias("turn")
    )
    # NULL comes first in Spark's order of structs
    listed = of.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(found: DataFrame, family: int = FAMILY) -> DataFrame:
    """``found`` with each conversation's first h turns taken from the first of its family; h is crc32(conv_id) mod 4."""
    lent = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    own = found.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("first_id"), lent.alias("h"), "turns")
    heads = found.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, 3).alias("head"))
    none = F.slice("turns", 1, 0)
    # a head meets at most 2 * family conversations
    return own.join(heads, "first_id", "left").select(
        "conv_id",
        F.concat(
            F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), 1, F.greatest("h", F.lit(1)))).otherwise(none),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))),
        ).alias("turns"),
    )


def trie(found: DataFrame, parts: int | None = None) -> DataFrame:
    """The trie's nodes, one row each, of ``found(conv_id, turns)`` as :func:`sequences` gives it.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``; a node's turns are
    the first ``depth`` of conversation ``conv_id``. ``parts`` is chosen by size when not given.
    """
    spark = found.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    held = written(found.select("conv_id", path.alias("path"), F.col("turns.words").alias("words")), "trie-paths")
    size = held.agg(F.sum(F.length("path")).alias("b")).first()["b"] or 0
    parts = parts or max(-(-size // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = held.repartitionByRange(parts, "path", "conv_id").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "trie-parts")
    nodes = written(ranged.join(_edges(ranged), "part").groupBy("part").applyInArrow(_part_nodes, NODE), "trie-nodes")
    return _folded(nodes)


def _edges(ranged: DataFrame) -> DataFrame:
    """``part, before, after``: turns that a part's first and last conversation share with the neighbours; -1 at the ends.

    One row per part; what is compared, and moved, is two conversations of each.
    """
    spark = ranged.sparkSession
    ends = ranged.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    ends = written(ends, "trie-ends")
    order = sorted(r.part for r in ends.select("part").collect())
    pairs = spark.createDataFrame(list(zip(order, order[1:])), "part int, next int")
    high = ends.select("part", "high")
    low = ends.select(F.col("part").alias("next"), "low")

    def common_turns(batches):
        for batch in batches:
            shared = [_shared(a.as_py(), b.as_py()) for a, b in zip(batch.column("high"), batch.column("low"))]
            columns = [batch.column("part"), batch.column("next"), pa.array(shared, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "next", "shared"])

    met = pairs.join(high, "part").join(low, "next").select("part", "next", "high", "low")
    shared = {(r.part, r.next): r.shared for r in met.mapInArrow(common_turns, "part int, next int, shared long").collect()}
    at = [-1, *(shared[pair] for pair in zip(order, order[1:])), -1]
    return spark.createDataFrame(list(zip(order, at, at[1:])), "part int, before long, after long")


def _shared(one: bytes, other: bytes) -> int:
    """Turns that two conversations share at their start."""
    least = min(len(one), len(other)) // DIGEST * DIGEST
    unlike = np.flatnonzero(np.frombuffer(one, np.uint8, least) != np.frombuffer(other, np.uint8, least))
    return (int(unlike[0]) if len(unlike) else least) // DIGEST


def common_prefixes(paths: list[bytes]) -> np.ndarray:
    """LCP of each conversation with the one before, in turns, with -1 before the first and after the last."""
    n = len(paths)
    length = np.array([len(p) // DIGEST for p in paths])
    start = np.concatenate([[0], np.cumsum(length)])
    turns = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = 0
    alive = np.arange(1, n)
    while len(alive):
        depth = lcp[alive]
        alive = alive[(depth < length[alive]) & (depth < length[alive - 1])]
        at = lcp[alive]
        alive = alive[(turns[start[alive] + at] == turns[start[alive - 1] + at]).all(1)]
        lcp[alive] += 1
    return lcp


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row k holds the minimum of every range of 2**k values."""
    rows, width = [values], 1
    while 2 * width <= len(values):
        last = rows[-1]
        rows.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    return rows


def range_minimum(rows: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low..high]``, both included, by two ranges that overlap."""
    level = np.log2(high - low + 1).astype(int)
    out = np.empty(len(low), rows[0].dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(rows[k][low[own]], rows[k][high[own] - (1 << k) + 1])
    return out


def left_extent(rows: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first conversation that shares ``depth`` turns with conversation ``at``."""
    at = at.copy()
    for k in reversed(range(len(rows))):
        low = at - (1 << k) + 1
        fits = low >= 0
        fits[fits] = rows[k][low[fits]] >= depth[fits]
        at[fits] -= 1 << k
    return at


def right_extent(rows: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last conversation that shares ``depth`` turns with conversation ``at``."""
    at = at.copy()
    for k in reversed(range(len(rows))):
        fits = at + 1 < len(rows[k])
        fits[fits] = rows[k][at[fits] + 1] >= depth[fits]
        at[fits] += 1 << k
    return at


def _part_nodes(part: pa.Table) -> pa.Table:
    """All nodes of one part; the open ones with what this part adds to them."""
    conv, paths = part["conv_id"].to_pylist(), part["path"].to_pylist()
    order = sorted(range(len(conv)), key=lambda i: (paths[i], conv[i]))
    conv, paths = np.array([conv[i] for i in order], np.int64), [paths[i] for i in order]
    words = part["words"].combine_chunks().take(pa.array(order)).flatten().to_numpy().astype(np.int64)
    before, after, number = part["before"][0].as_py(), part["after"][0].as_py(), part["part"][0].as_py()

    n = len(paths)
    length = np.array([len(p) // DIGEST for p in paths])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    lcp = common_prefixes(paths)
    rows = sparse_table(lcp)

    # candidates, each with its own extents; equal prefixes fall together
    at = np.concatenate([np.arange(1, n), np.arange(n)])
    deep = np.concatenate([lcp[1:n], length])
    left, right = left_extent(rows, at, deep), right_extent(rows, at, deep)
    key, kept = np.unique(np.stack([left, deep], 1), axis=0, return_index=True)
    left, deep, right = key[:, 0], key[:, 1], right[kept]
    # depths above a candidate down to which its members are the same
    top = np.maximum(lcp[left], lcp[right + 1])
    many = deep - top
    of = np.repeat(np.arange(len(deep)), many)
    l, r = left[of], right[of]  # noqa: E741
    t = top[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    order = np.lexsort((t, l))
    l, r, t = l[order], r[order], t[order]  # noqa: E741

    # (l, t) is node number first[l] + t - lcp[l] - 1: a conversation begins the nodes below what it shares
    first = np.concatenate([[0], np.cumsum(length - lcp[:n])])
    above = np.where(t - 1 > lcp[l], np.arange(len(t)) - 1, -1)
    hung = np.flatnonzero((above < 0) & (t > 0))
    begin = left_extent(rows, l[hung], t[hung] - 1)
    above[hung] = first[begin] + t[hung] - 1 - lcp[begin] - 1

    size = r - l + 1
    weight = np.where(t > 0, words[np.minimum(start[l] + t - 1, max(len(words) - 1, 0))] if len(words) else 0, 0)
    same = np.zeros(n, bool)  # equal to the conversation before
    same[1:] = (lcp[1:n] == length[1:]) & (length[1:] == length[:-1])
    run = np.flatnonzero(~same)
    copies = np.zeros(n, np.int64)
    copies[run] = np.diff(np.append(run, n))
    ends = np.where(length[l] == t, copies[l], 0)
    opens_left, opens_right = (l == 0) & (t <= before), (r == n - 1) & (t <= after)

    below = first[r + 1]
    here = np.arange(len(t))

    def over_subtree(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[below] - total[here]

    leaf = (ends == size) & ~opens_right
    children = np.bincount(above[(t > 0) & ~opens_left], minlength=len(t))
    opens = opens_left | opens_right
    keys = _prefix_keys(paths[0], before, paths[-1], after)
    smallest = range_minimum(sparse_table(conv), l, r)

    def key_of(node: int) -> str | None:
        return keys[bool(opens_left[node])][t[node]]

    shut = ~opens & (t > 0)
    known = shut & ~opens[above]  # -1 is looked up for the root only, which `shut` leaves out
    parent = pa.array(np.where(known, smallest[above], 0), mask=~known)
    parent_keys = [key_of(a) if a >= 0 and opens[a] else None for a in above.tolist()]
    digests = []
    for node, (a, k) in enumerate(zip(l.tolist(), ends.tolist())):
        listed = ",".join(map(str, conv[a : a + k].tolist()))
        digests.append(listed if opens[node] else hashlib.sha256(listed.encode()).hexdigest())
    columns = [
        pa.array(smallest), pa.array(t), pa.array(size), pa.array(children), pa.array(over_subtree(leaf.astype(np.int64))),
        pa.array(over_subtree(size * weight)).cast(pa.decimal128(38, 0)),
        pa.array(over_subtree(np.where(opens_left, 0, weight))).cast(pa.decimal128(38, 0)),
        pa.array(digests, pa.string()), pa.array([key_of(i) if opens[i] else None for i in range(len(t))], pa.string()),
        pa.array(parent_keys, pa.string()), parent, pa.array(opens), pa.array(np.full(len(t), number, np.int32)),
    ]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in NODE.split(", ")])


def _prefix_keys(low: bytes, before: int, high: bytes, after: int) -> tuple[list[str], list[str]]:
    """Digests of the open prefixes: of the last conversation, and of the first, by depth."""

    def chain(path: bytes, deepest: int) -> list[str]:
        state = hashlib.sha256()
        found = [state.hexdigest()] if deepest >= 0 else []
        for depth in range(deepest):
            state.update(path[DIGEST * depth : DIGEST * (depth + 1)])
            found.append(state.copy().hexdigest())
        return found

    return chain(high, after), chain(low, before)


def _folded(nodes: DataFrame) -> DataFrame:
    """Open nodes folded over parts; parents of the nodes that hang on them."""
    opened = nodes.where("opens")
    folded = opened.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_n", "saved_w")],
    )
    # ids come in order of the parts: a stream through one digest per node
    ends = opened.where("ends <> ''").select("key", "part", "ends").repartition("key").sortWithinPartitions("key", "part")
    digests = ends.mapInArrow(_stream_digests, "key string, ends string")
    folded = folded.join(digests, "key", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)))
    folded = written(folded, "trie-open")
    named = folded.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_n", "saved_w", "ends"]
    closed = nodes.where("NOT opens")
    whole = closed.where("parent_key IS NULL").select(*columns)
    hung = closed.where("parent_key IS NOT NULL").drop("parent_conv_id").join(named, "parent_key").select(*columns)
    joint = folded.join(named, "parent_key", "left").select(*columns)
    return whole.unionByName(hung).unionByName(joint).select(
        *columns[:6], (F.col("saved_n") - F.col("saved_w")).cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )


def _stream_digests(batches):
    now, state = None, None
    schema = pa.schema([("key", pa.string()), ("ends", pa.string())])
    for batch in batches:
        done = []
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key == now:
                state.update(b"," + ends.encode())
            else:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], schema=schema)


def last_turns(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` but the root with the digest of their last turn, looked up in ``found`` by conversation and depth."""
    each = found.select("conv_id", F.posexplode("turns").alias("place", "turn"))
    each = each.select("conv_id", (F.col("place") + 1).cast("long").alias("depth"), F.col("turn.digest").alias("digest"))
    return nodes.join(each, ["conv_id", "depth"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie(rebuilt(sequences(common.table(spark, sf_dir, "conversations"))))


OP13_SQL = r"""
WITH RECURSIVE ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), lent AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first_id,
         xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(conv_id::VARCHAR) + 1),
               lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
             lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)
), chosen AS (
  SELECT l.conv_id, o.place, o.role, o.text FROM lent l JOIN ordered o ON o.conv_id = l.first_id WHERE o.place <= l.h
  UNION ALL
  SELECT l.conv_id, o.place, o.role, o.text FROM lent l JOIN ordered o ON o.conv_id = l.conv_id WHERE o.place > l.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth,
         md5(concat(length(role), ':', role, text)) AS turn,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM chosen
), paths AS (
  SELECT conv_id, depth, words, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path
  FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM lent
), linked AS (
  SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM paths
), nodes AS (
  SELECT path, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM linked GROUP BY path
), counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent = n.path) AS n_children FROM nodes n
), sums AS (
  SELECT a.path, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM counted n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  GROUP BY a.path
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       sha256(n.ended) AS ends_sha256
FROM counted n JOIN sums s USING (path) LEFT JOIN nodes p ON n.parent = p.path
"""
