"""SimHash near-duplicates: fingerprints in vantage-point tree shards, linked by exact bit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import components, keep_rows, prepare, row_key, spool

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Distinct fingerprints that a shard is meant to hold (8 MB), and the sample (a documented bound) that its tree is fitted on.
#: Balls around fingerprints cross some 40 % of any median border, so every level of the tree over the shards sends 1.4 times
#: the rows; within a shard the same levels cost time only. A shard therefore holds all that a task can search in half a minute.
SHARD_PRINTS, SAMPLE_PRINTS, LEAF = 1 << 20, 65536, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; a text without words has zero."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for a in range(0, n, 4096):
        ones += np.unpackbits(values[a : a + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(shingle: int = SHINGLE):
    """A function of a text column: its fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return prints


class Shards:
    """The top of a vantage-point tree: each node splits fingerprints at the median distance to one of them."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, inner, outer; children below zero are shards
        self.n = 0
        self.root = self._grow(sample, depth)

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        split = _split(sample) if depth and len(sample) > 1 else None
        if split is None:
            self.n += 1
            return -self.n
        vantage, radius, inside = split
        self.nodes.append((vantage, radius, 0, 0))
        at = len(self.nodes) - 1
        self.nodes[at] = (vantage, radius, self._grow(sample[inside], depth - 1), self._grow(sample[~inside], depth - 1))
        return at

    def route(self, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): its home, and each shard that the triangle bound cannot rule out."""
        rows, shards, homes = [], [], []
        todo = [(self.root, np.arange(len(prints)), np.ones(len(prints), bool))]
        while todo:
            at, row, home = todo.pop()
            if not len(row):
                continue
            if at < 0:
                rows.append(row)
                shards.append(np.full(len(row), -at - 1, np.int64))
                homes.append(home)
                continue
            vantage, radius, inner, outer = self.nodes[at]
            d = _distance(prints[row], vantage)
            near, far = d <= radius + max_bits, d > radius - max_bits
            todo += [(inner, row[near], (home & (d <= radius))[near]), (outer, row[far], (home & (d > radius))[far])]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, shards, homes))


def _distance(prints: np.ndarray, one: int) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(one)).astype(np.int16)


def _split(prints: np.ndarray):
    """A vantage point, its median radius and who is inside; None where all are equally far."""
    for k in (0, len(prints) // 3, 2 * len(prints) // 3):
        d = _distance(prints, int(prints[k]))
        radius = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        if radius == d.max():
            radius -= 1
        inside = d <= radius
        if inside.any() and not inside.all():
            return int(prints[k]), radius, inside
    return None


def links(home: np.ndarray, queries: np.ndarray, max_bits: int):
    """Pairs (query index, home index) within ``max_bits``: a vantage-point tree over ``home``, searched by all at once."""
    todo = [(np.arange(len(home)), np.arange(len(queries)))]
    while todo:
        own, ask = todo.pop()
        if not len(ask):
            continue
        split = _split(home[own]) if len(own) > LEAF else None
        if split is None:
            step = max(1, 1_000_000 // len(own))
            for a in range(0, len(ask), step):
                part = ask[a : a + step]
                q, h = np.nonzero(np.bitwise_count(queries[part][:, None] ^ home[own][None, :]) <= max_bits)
                if len(q):
                    yield part[q], own[h]
            continue
        vantage, radius, inside = split
        d = _distance(queries[ask], vantage)
        todo += [(own[inside], ask[d <= radius + max_bits]), (own[~inside], ask[d > radius - max_bits])]


def _stars(max_bits: int):
    """A shard's links as stars: each linked fingerprint with the least of its group within the shard."""

    def stars(key, rows: pd.DataFrame) -> pd.DataFrame:
        home = np.unique(rows.fp[rows.home].to_numpy().view(np.uint64))
        prints = np.unique(rows.fp.to_numpy().view(np.uint64))
        parent = np.arange(len(prints))
        place = np.searchsorted(prints, home)
        for q, h in links(home, prints, max_bits):
            parent = _unite(parent, q, place[h])
        top = parent[parent]
        signed = prints.view(np.int64)
        least = np.full(len(prints), np.iinfo(np.int64).max)
        np.minimum.at(least, top, signed)
        linked = signed != least[top]
        return pd.DataFrame({"a": signed[linked], "b": least[top[linked]]})

    return stars


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of classes along links: roots take the lesser root, then all are flattened, until links agree."""
    while True:
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            return parent
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (flat := parent[parent]).tobytes() != parent.tobytes():
            parent = flat


def link_prints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Classes of distinct fingerprints (``fp`` long): rows ``node``, ``root`` for each that links to another.

    A bounded sample fits the top of the tree; every fingerprint goes to its home shard and to
    each shard that its ball crosses into, so every link is found in its home's shard.
    """
    spark = prints.sparkSession
    n = prints.count()
    depth = max(0, -(-n // SHARD_PRINTS) - 1).bit_length()
    most = min(SAMPLE_PRINTS, 64 << depth)
    # hashes are even, so a bound on them gives about as many as wanted; without a tree none is needed
    chosen = prints if n <= most else prints.where(F.xxhash64("fp") < F.lit(-(1 << 63) + (most << 64) // n))
    sample = sorted(r.fp for r in chosen.select("fp").collect()) if depth else []
    tree = spark.sparkContext.broadcast(Shards(np.array(sample, np.int64).view(np.uint64), depth))

    def routed(frames):
        for frame in frames:
            row, shard, home = tree.value.route(frame.fp.to_numpy().view(np.uint64), max_bits)
            yield pd.DataFrame({"shard": shard.astype(np.int64), "fp": frame.fp.to_numpy()[row], "home": home.astype(bool)})

    sent = prints.select("fp").mapInPandas(routed, "shard long, fp long, home boolean")
    edges = sent.groupBy("shard").applyInPandas(_stars(max_bits), "a long, b long")
    return components(edges, "simhash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col``, ``fp`` (signed long), ``component_id``, ``root`` (the component's least fingerprint) and the row's key ``_k1``, ``_k2``, for each row.

    ``component_id`` is the smallest id among the rows reachable through fingerprints that differ
    in at most ``max_bits`` bits; null if none of them has an id. Null and empty texts have
    fingerprint zero and link like others. Equal fingerprints are one node, so exact copies and
    repeated rows cost nothing more; rows that are equal in every column share their key.
    """
    prepare(docs.sparkSession)
    rows = spool(docs.select(F.col(f"`{id_col}`").alias("id"), *row_key(docs), fingerprint_column(shingle)(F.col(f"`{text_col}`")).alias("fp")), "simhash-prints")
    prints = spool(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = link_prints(prints, max_bits)
    known = prints.join(roots, prints.fp == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root", "_k1", "_k2")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per near-duplicate component: that of the smallest id (of ties, and of null ids, the smallest row key).

    The rows kept are unchanged, with all their columns; of rows equal in every column, one stays.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    rank = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), "_k1", "_k2")
    best = found.groupBy("root").agg(F.min(rank).alias("best")).select("best._k1", "best._k2")
    return keep_rows(docs, best)
