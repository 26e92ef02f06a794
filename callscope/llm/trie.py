"""Conversation prefix trie: vertical bitmaps per shard, walked depth first, nodes merged over all shards."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import partitions, prepare, spool

#: Conversations meant for a shard, and turns of each conversation that one shard holds.
SHARD_CONVS, SEGMENT = 1024, 64
#: A rebuilt conversation starts with at most ``HEADS - 1`` turns of the first conversation of its ``FAMILY``.
HEADS, FAMILY = 6, 100

_NODE = "depth long, p1 long, p2 long, q1 long, q2 long, least long, n long, last long, ends array<long>"
_SUMS = "depth long, p1 long, p2 long, leaves long, saved long"


def positions(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``k1``, ``k2`` (digests of role and text) and ``len`` (code points) of every turn.

    Turns are ordered by ``turn`` (null first); of equal ones by role, then by digest. The order is
    made by a range partitioning and counted by partition, so one conversation may span many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("k1"),
        F.xxhash64(F.lit(2), role, text).alias("k2"), F.char_length(text).cast("long").alias("len"), F.rand(7).alias("tie"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "k1", "k2", "tie"]
    dealt = spool(slim.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order).select(
        "conv_id", "k1", "k2", "len", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "trie-turns")
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")).select(
        "conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return dealt.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "k1", "k2", "len")


def rebuild(turns: DataFrame) -> DataFrame:
    """The rebuilt conversations: their turns as of :func:`positions`, and a row of position 0 for each conversation."""
    own = spool(positions(turns), "trie-own")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).select("conv_id", base.alias("base"), head.alias("h"))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(
        F.col("conv_id").alias("base"), "pos", "k1", "k2", "len")
    taken = spool(convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "k1", "k2", "len"), "trie-heads")
    known = convs.join(taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken")), "conv_id", "left").select(
        "conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    tails = own.join(known, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "k1", "k2", "len")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("pos"), zero.alias("k1"), zero.alias("k2"), zero.alias("len"))
    return taken.union(tails).union(roots)


def _segments(rows: DataFrame) -> DataFrame:
    """``rows`` with their shard (``block``, ``seg``), the conversation's ``size`` and the digests ``s1``, ``s2`` of its path before the segment."""
    spark = rows.sparkSession
    marked = rows.withColumn("seg", F.floor(F.col("pos") / SEGMENT)).withColumns(
        {f"m{i}": F.when(F.col("pos") > 0, F.xxhash64(F.lit(i), "pos", "k1", "k2")).otherwise(0) for i in (1, 2)})
    marked = spool(marked, "trie-marked")
    parts = marked.groupBy("conv_id", "seg").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.max("pos").alias("top"))
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "seg", *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)],
                          F.max("top").over(Window.partitionBy("conv_id")).alias("size"))
    blocks = max(partitions(spark), -(-marked.where("pos = 0").count() // SHARD_CONVS))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    return spool(marked.join(starts, ["conv_id", "seg"]).withColumn("block", F.pmod(F.xxhash64(family), F.lit(blocks))), "trie-shards")


class Shard:
    """Postings of one shard: for each (position, turn) the bitset of the conversations that have it there."""

    def __init__(self, rows: pd.DataFrame):
        self.convs, bit = np.unique(rows.conv_id.to_numpy(), return_inverse=True)
        self.postings: dict[tuple[int, int, int], int] = {}
        self.turns: dict[tuple[int, int], tuple] = {}
        self.present: dict[int, int] = {}
        self.starts: dict[tuple[int, int], int] = {}
        self.sizes = [0] * len(self.convs)
        for i, pos, k1, k2, size, m1, m2, length, s1, s2 in zip(bit.tolist(), *(rows[c].tolist() for c in (
                "pos", "k1", "k2", "size", "m1", "m2", "len", "s1", "s2")), strict=True):
            one = 1 << i
            self.postings[pos, k1, k2] = self.postings.get((pos, k1, k2), 0) | one
            self.turns[i, pos] = k1, k2, m1, m2, length
            self.present[pos] = self.present.get(pos, 0) | one
            self.starts[s1, s2] = self.starts.get((s1, s2), 0) | one
            self.sizes[i] = size
        self.first = min(self.present)

    def walk(self) -> Iterator[tuple]:
        """Every node: (depth, its path's digests, its parent's, length of its last text, bitset of members)."""
        todo = [(self.first - 1, *start, bits) for start, bits in self.starts.items()]
        while todo:
            depth, p1, p2, bits = todo.pop()
            rest = bits & self.present.get(depth + 1, 0)
            while rest:
                k1, k2, m1, m2, length = self.turns[(rest & -rest).bit_length() - 1, depth + 1]
                child = bits & self.postings[depth + 1, k1, k2]
                rest &= ~child
                node = depth + 1, p1 ^ m1, p2 ^ m2
                yield *node, p1, p2, length, child
                todo.append((*node, child))


def _members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _nodes(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The shard's nodes: least member, number of members, and the list of those that end there."""
    shard, out = Shard(rows), []
    ending: dict[int, int] = {}
    for i, size in enumerate(shard.sizes):
        ending[size] = ending.get(size, 0) | 1 << i
    for depth, p1, p2, q1, q2, length, bits in shard.walk():
        least = int(shard.convs[(bits & -bits).bit_length() - 1])
        ends = [int(shard.convs[i]) for i in _members(bits & ending.get(depth, 0))]
        out.append((depth, p1, p2, q1, q2, least, bits.bit_count(), length, ends))
    return pd.DataFrame(out, columns=["depth", "p1", "p2", "q1", "q2", "least", "n", "last", "ends"])


def _sums(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The shard's nodes: leaves owned by members, and the code points at or below the node that members do not own."""
    shard, out = Shard(rows), []
    place = {int(c): i for i, c in enumerate(shard.convs)}
    leaf, later, owned = [0] * len(place), [0] * len(place), [0] * len(place)
    for c, is_leaf, rest, own in zip(rows.conv_id.tolist(), rows.leaf.tolist(), rows.later.tolist(), rows.owned.tolist(), strict=True):
        leaf[place[c]], later[place[c]], owned[place[c]] = is_leaf, rest, own
    tail = {}
    for i, pos in sorted(shard.turns, key=lambda x: -x[1]):
        tail[i, pos] = tail.get((i, pos + 1), later[i]) + (shard.turns[i, pos][4] if pos < owned[i] else 0)
    for depth, p1, p2, _, _, _, bits in shard.walk():
        members = _members(bits)
        out.append((depth, p1, p2, sum(leaf[i] for i in members), sum(tail[i, depth] for i in members)))
    return pd.DataFrame(out, columns=["depth", "p1", "p2", "leaves", "saved"])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's conversation ids, streamed: rows come sorted by node and id."""
    node, sha = None, None
    for frame in frames:
        out = []
        keys = list(zip(frame.depth.tolist(), frame.p1.tolist(), frame.p2.tolist(), strict=True))
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            text = ",".join(map(str, frame.conv_id[a:b].tolist()))
            if keys[a] == node:
                sha.update(b"," + text.encode())
                continue
            if node is not None:
                out.append((*node, sha.hexdigest()))
            node, sha = keys[a], hashlib.sha256(text.encode())
        yield pd.DataFrame(out, columns=["depth", "p1", "p2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=["depth", "p1", "p2", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``): one row per node.

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Rows without a ``conv_id`` belong to no
    conversation and are left out; null role or text counts as empty; equal ``turn`` values are
    ordered by role, then by a digest of the text; repeated rows are turns of their own; other
    columns are ignored; texts of any length are only digested and counted. An empty table has no
    conversation and no node.

    A shard holds ``SEGMENT`` positions of about ``SHARD_CONVS`` conversations. It meets the rest
    of the trie only in the sums over all shards, so neither a long conversation nor a first turn
    that all share has to be held by one task. The least member of a node owns it; what lies in a
    subtree is then a sum over members (of leaves they own, of turns they share), made by a second
    walk over the same shards.
    """
    prepare(turns.sparkSession)
    rows = _segments(rebuild(turns))
    key = ["depth", "p1", "p2"]
    found = spool(rows.groupBy("block", "seg").applyInPandas(_nodes, _NODE), "trie-found")
    nodes = spool(found.groupBy(*key).agg(*[f(c).alias(c) for f, c in (
        (F.max, "q1"), (F.max, "q2"), (F.min, "least"), (F.sum, "n"), (F.max, "last"))]), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = spool(nodes.join(children, key, "left").fillna(0, ["n_children"]), "trie-counted")
    owners = nodes.groupBy(F.col("least").alias("conv_id")).agg(
        F.min("depth").alias("owned"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    owned = F.coalesce("owned", F.col("size") + 1)
    weighed = rows.join(owners, "conv_id", "left").withColumns({"owned": owned, "leaf": F.coalesce("leaf", F.lit(0))})
    weighed = spool(weighed, "trie-weighed")
    after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    later = weighed.groupBy("conv_id", "seg").agg(F.sum(F.when(F.col("pos") < F.col("owned"), F.col("len")).otherwise(0)).alias("w")).select(
        "conv_id", "seg", F.coalesce(F.sum("w").over(after), F.lit(0)).alias("later"))
    sums = weighed.join(later, ["conv_id", "seg"]).groupBy("block", "seg").applyInPandas(_sums, _SUMS).groupBy(*key).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = found.select(*key, F.explode("ends").alias("conv_id")).repartition(*key).sortWithinPartitions(*key, "conv_id")
    digests = ends.mapInPandas(_digests, "depth long, p1 long, p2 long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, key).join(digests, key, "left").join(parents, ["depth", "q1", "q2"], "left")
            .select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))


#: DuckDB: nodes are the distinct turn lists; a subtree is all nodes whose list starts with it.
ORACLE = """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
taken AS (SELECT c.conv_id, o.pos, o.turn FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h),
parts AS (
  SELECT conv_id, 0 AS part, pos, turn FROM taken
  UNION ALL SELECT o.conv_id, 1, o.pos, o.turn FROM own o JOIN convs c USING (conv_id) WHERE o.pos > c.h),
rebuilt AS (
  SELECT c.conv_id, coalesce(p.turns, []) AS turns
  FROM convs c LEFT JOIN (SELECT conv_id, list(turn ORDER BY part, pos) AS turns FROM parts GROUP BY conv_id) p USING (conv_id)),
paths AS (
  SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ending, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS last
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, path, path[1:depth - 1] AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(last) AS last,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends
  FROM paths GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (depth, path)),
above AS (SELECT d AS depth, path[1:d] AS path, k, (n - 1) * last AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted)),
sums AS (SELECT depth, path, count(*) FILTER (WHERE k = 0) AS leaves, sum(saved) AS saved FROM above GROUP BY depth, path)
SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, c.n::BIGINT AS n_convs, c.k::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM counted c JOIN sums s USING (depth, path) LEFT JOIN nodes p ON c.depth > 0 AND p.depth = c.depth - 1 AND p.path = c.up
"""
