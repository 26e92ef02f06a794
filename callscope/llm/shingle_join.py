"""Jaccard join of word-shingle sets: signature trees with OR-combined bitmaps and size ranges, searched two at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import bitmap, bitmap_bits, components, in_bitmap, partitions, prepare, row_key, spool

SHINGLE, PERCENT = 4, 85
#: Linked sets share at least this part of a set's size, in percent, in their prefixes; rounds that drop sets which share less.
CORE, ROUNDS = 3, 3
#: Sets and shingles meant for a unit of work, shingles for a bin of small families, and sets of a leaf.
UNIT_SETS, UNIT_SHINGLES, BIN_SHINGLES, LEAF = 4096, 4 << 20, 1 << 20, 16
#: Sets that every unit of a large family holds, so that most links between units are found in the first round.
PIVOTS = 64
#: Counters of the sketch that orders shingles, bytes of one row of it, and its count from which a shingle's group is dealt over several tasks.
SLOTS, ROW_SLOTS, HOT, DEALS = 1 << 20, 1 << 14, 10_000, 32
#: Bits and least bits of a set's bitmap, and the most bytes that the bitmaps of one tree may take.
BITS, LEAST_BITS, TREE_BYTES = 8, 256, 64 << 20
#: Distinct words whose hashes a task remembers, and bytes of a text that are split at once.
MEMO, SLICE = 1 << 20, 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PROFILE = "id long, _k1 long, _k2 long, n long, cls binary, row int, counts binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_memo = _Hashes()


def shingles(raw: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (of fewer words: of the whole sequence; of none: nothing)."""
    raw, parts, a = (raw or b"").lower(), [], 0
    while a < len(raw):
        cut = _SPACE.search(raw, a + SLICE)
        b = cut.start() if cut else len(raw)
        words = raw[a:b].split()
        parts.append(np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words)))
        a = b
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _least(n):
    """The least number of shingles that a set of ``n`` shares with any that it links to."""
    return -(-PERCENT * n // 100)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.sort(np.concatenate([a, b]), kind="stable")  # merges two sorted runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of each row's set; at the end, how often each slot's shingles were met."""
    counts, seen, held, waiting = np.zeros(SLOTS, np.uint32), set(), [], 0

    def count():
        nonlocal waiting
        if held:
            np.add(counts, np.bincount((np.concatenate(held) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32), out=counts)
        held.clear()
        waiting = 0

    def made(k: int, **columns) -> pa.RecordBatch:
        types = {"id": pa.int64(), "_k1": pa.int64(), "_k2": pa.int64(), "n": pa.int64(), "cls": pa.binary(), "row": pa.int32(), "counts": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(k, t))
                                           for c, t in types.items()], names=list(types))

    for batch in batches:
        sizes, classes = [], []
        for text in batch["text"].to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            if len(found) and classes[-1] not in seen:
                if len(seen) < MEMO:
                    seen.add(classes[-1])
                held.append(found)
                waiting += len(found)
                if waiting >= SLOTS:
                    count()
        yield made(batch.num_rows, id=batch["id"], _k1=batch["_k1"], _k2=batch["_k2"], n=sizes, cls=classes)
    count()
    rows = [k for k in range(SLOTS // ROW_SLOTS) if counts[k * ROW_SLOTS : (k + 1) * ROW_SLOTS].any()]
    yield made(len(rows), row=rows, counts=[counts[k * ROW_SLOTS : (k + 1) * ROW_SLOTS].astype("<u4").tobytes() for k in rows])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketch's rows (of counts too large for their type, the largest value)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, counts in zip(batch["row"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            sums[row] = np.minimum(sums.get(row, np.uint64(0)) + np.frombuffer(counts, "<u4").astype(np.uint64), np.uint64(2**32 - 1))
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<u4").tobytes() for x in sums.values()], pa.binary())], names=["row", "counts"])


def _prefixes(sketch, hot: int):
    """Each set's rarest shingles: any two sets that link share at least ``CORE`` % of the smaller one's size, plus one, of them."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in batches:
            found, nodes, sizes, deals = [], [], [], []
            for text in batch["text"].to_pylist():
                h = shingles(text)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                if not len(h) or digest in seen:
                    continue
                if len(seen) < MEMO:
                    seen.add(digest)
                often = counts[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                rare = np.lexsort((h, often))[: len(h) - _least(len(h)) + 1 + CORE * len(h) // 100]
                node = int(np.uint64(xxhash.xxh64_intdigest(digest, 42)).view(np.int64))  # Spark's xxhash64
                found.append(h[rare].view(np.int64))
                nodes.append(np.full(len(rare), node, np.int64))
                sizes.append(np.full(len(rare), len(h), np.int32))
                deals.append(np.where(often[rare] >= hot, node % DEALS, -1).astype(np.int32))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, nodes, sizes, deals)], names=["shingle", "node", "n", "deal"])

    return prefixes


class Tree:
    """A signature tree over sets: nodes hold the OR of bitmaps, the range of sizes, and the most shingles that a bitmap lost."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for k, s in enumerate(sets):
            at = (s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
            flags = np.zeros(bits, np.uint8)
            flags[at] = 1
            maps[k] = np.packbits(flags)
        self.maps = maps.view(np.uint64)
        self.lost = self.n - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        starts = np.arange(0, len(sets), LEAF)
        level = [np.bitwise_or.reduceat(self.maps, starts), np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts), np.maximum.reduceat(self.lost, starts)]
        self.levels = [level]
        while len(level[0]) > 1:
            pairs = np.arange(0, len(level[0]), 2)
            level = [f.reduceat(x, pairs) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level, strict=True)]
            self.levels.append(level)

    def span(self, level: int, at: int) -> tuple[int, int]:
        width = LEAF << level
        return at * width, min(len(self.sets), (at + 1) * width)


def tree_order(sets: list[np.ndarray]) -> np.ndarray:
    """Sets of like size, and of these such that share their least shingle, side by side."""
    n = np.array([len(s) for s in sets], float)
    return np.lexsort((n, [int(s[0]) for s in sets], np.floor(np.log(n) / -np.log(PERCENT / 100))))


def tree_bits(*groups: list[np.ndarray]) -> int:
    """Bits of the bitmaps of trees that are to be compared."""
    most = max(len(s) for g in groups for s in g)
    bits = max(LEAST_BITS, 1 << (most * BITS - 1).bit_length())
    while bits > LEAST_BITS and bits // 8 * max(map(len, groups)) > TREE_BYTES:
        bits //= 2
    return bits


def join_trees(x: Tree, y: Tree, root: np.ndarray, first: int, second: int) -> Iterator[tuple[int, int]]:
    """Links between sets of two trees (or within one) that join different classes; ``root`` has the classes and is kept up to date.

    Sets of ``x`` have their class at ``first`` + number, those of ``y`` at ``second`` + number.
    A pair of nodes is left when sizes, the most that the bitmaps let them share, or a common class
    of all their sets rule out any new link.
    """
    same = x is y
    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        i, a, j, b = todo.pop()
        (xs, xe), (ys, ye) = x.span(i, a), y.span(j, b)
        if xs >= xe or ys >= ye:
            continue
        mine, theirs = root[first + xs : first + xe], root[second + ys : second + ye]
        if (mine[0] == mine).all() and (mine[0] == theirs).all():
            continue
        if not same or (i, a) != (j, b):
            (u, lo, hi, lost), (v, lo2, hi2, lost2) = ([c[k] for c in level] for level, k in ((x.levels[i], a), (y.levels[j], b)))
            most = min(hi, hi2, int(np.bitwise_count(u & v).sum(dtype=np.int64)) + min(lost, lost2))
            if 100 * hi < PERCENT * lo2 or 100 * hi2 < PERCENT * lo or (100 + PERCENT) * most < PERCENT * (lo + lo2):
                continue
        if i or j:
            left = [(i - 1, 2 * a), (i - 1, 2 * a + 1)] if i >= j else [(i, a)]
            right = [(j - 1, 2 * b), (j - 1, 2 * b + 1)] if j >= i else [(j, b)]
            pairs = [(*p, *q) for p in left for q in right]
            if same and (i, a) == (j, b):
                pairs = [(*left[0], *left[0]), (*left[1], *left[1]), (*left[0], *left[1])]
            todo += [p for p in reversed(pairs) if p[1] < len(x.levels[p[0]][0]) and p[3] < len(y.levels[p[2]][0])]
            continue
        shared = np.bitwise_count(x.maps[xs:xe, None] & y.maps[None, ys:ye]).sum(2, dtype=np.int64) + np.minimum(x.lost[xs:xe, None], y.lost[None, ys:ye])
        total = x.n[xs:xe, None] + y.n[None, ys:ye]
        shared = np.minimum(shared, np.minimum(x.n[xs:xe, None], y.n[None, ys:ye]))
        ps, qs = np.nonzero(((100 + PERCENT) * shared >= PERCENT * total) & (mine[:, None] != theirs[None, :]))
        for p, q in zip(ps.tolist(), qs.tolist(), strict=True):
            p, q = xs + p, ys + q
            r, s = root[first + p], root[second + q]
            if r != s and _linked(x.sets[p], y.sets[q]):
                root[root == max(r, s)] = min(r, s)
                yield p, q


def _sets(rows: pd.DataFrame) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct sets of the rows, in tree order, and their digests."""
    rows = rows.drop_duplicates("cls")
    sets = [shingles(t) for t in rows.text]
    order = tree_order(sets)
    return [rows.cls.iloc[k] for k in order], [sets[k] for k in order]


def _within(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Links within each family of a unit."""
    out = []
    for _, part in rows.groupby("family", sort=False):
        classes, sets = _sets(part)
        if len(sets) > 1:
            tree = Tree(sets, tree_bits(sets))
            out += [(classes[p], classes[q]) for p, q in join_trees(tree, tree, np.arange(len(sets)), 0, 0)]
    return pd.DataFrame(out, columns=["a", "b"])


def _between(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of a unit that join classes not yet joined."""
    sides = [rows[rows.side == k] for k in (0, 1)]
    if sides[0].empty or sides[1].empty:
        return pd.DataFrame([], columns=["a", "b"])
    label = dict(zip(rows.cls, rows.label, strict=True))
    (xc, xs), (yc, ys) = map(_sets, sides)
    numbers: dict[bytes, int] = {}
    root = np.array([numbers.setdefault(label[c], len(numbers)) for c in (*xc, *yc)])
    bits = tree_bits(xs, ys)
    return pd.DataFrame([(xc[p], yc[q]) for p, q in join_trees(Tree(xs, bits), Tree(ys, bits), root, 0, len(xs))], columns=["a", "b"])


def _families(docs: DataFrame, text, sketch) -> DataFrame:
    """``node``, ``family``: sets (by a hash of their digest) that are connected through shared rare shingles.

    A set stays only while it shares enough shingles with sets of a size that could link: fewer
    than any link has cannot be one, and what a set alone still shares with one that went is shared
    no more. So chance matches of a few shingles connect no families. A shingle so frequent that
    its group is dealt over tasks counts as shared.
    """
    place = Window.partitionBy("shingle", "deal").orderBy("n", "node")
    near_before, near_after = (100 * F.lag("n").over(place) >= PERCENT * F.col("n")), (100 * F.col("n") >= PERCENT * F.lead("n").over(place))

    def shared(rows, name):
        rows = rows.withColumns({"before": F.when(near_before, F.lag("node").over(place)), "after": near_after, "head": F.first("node").over(place)})
        return spool(rows.where("before is not null or after or deal >= 0"), name)

    pairs = docs.select(text).mapInArrow(_prefixes(sketch, HOT), "shingle long, node long, n int, deal int")
    rows = shared(pairs.repartition("shingle", "deal").distinct(), "join-shared")
    for _ in range(ROUNDS):
        enough = rows.groupBy("node", "n").agg(F.count(F.lit(1)).alias("had")).where(f"had > floor(n * {CORE * PERCENT} / 10000)").select("node")
        rows = shared(rows.select("shingle", "node", "n", "deal").join(enough, "node", "left_semi"), "join-shared")
    chain = rows.where("before is not null").select(F.col("node").alias("a"), F.col("before").alias("b"))
    dealt = rows.where("deal >= 0")
    heads = dealt.groupBy("shingle", "deal").agg(F.min("head").alias("head"))
    tops = heads.join(heads.groupBy("shingle").agg(F.min("head").alias("top")), "shingle").select("head", "top")
    edges = chain.union(dealt.select("node", "head")).union(tops)
    return components(edges, "join-families").select("node", F.col("root").alias("family"))


def _units(chosen: DataFrame) -> DataFrame:
    """``chosen`` (``family``, ``cls``, ``n`` and more) with the number of its family's sets and units, and its unit's key (``home``, ``unit``)."""
    size = chosen.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")).select(
        "family", "sets", "shingles", F.greatest(F.lit(1), F.ceil(F.col("sets") / UNIT_SETS), F.ceil(F.col("shingles") / UNIT_SHINGLES)).alias("units"))
    size = spool(size, "join-sizes")
    small = size.where("units = 1").agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    bins = max(partitions(chosen.sparkSession), -(-small // BIN_SHINGLES))
    large = F.col("units") > 1
    return chosen.join(size.drop("shingles"), "family").withColumns({
        "home": F.when(large, F.col("family")),
        "unit": F.when(large, F.pmod(F.xxhash64("cls"), "units")).otherwise(F.pmod(F.xxhash64("family"), F.lit(bins)))})


def _links(sets: DataFrame) -> DataFrame:
    """All links (as far as classes need them) among ``sets``: ``family``, ``cls``, ``n``, ``text`` and what :func:`_units` adds."""
    work = ["home", "unit", "family", "cls", "text"]
    large = sets.where("home is not null")
    units = F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("unit")
    pivots = large.where(F.pmod(F.xxhash64(F.lit(1), "cls"), "sets") < PIVOTS).select("home", units, "family", "cls", "text")
    edges = spool(sets.select(*work).union(pivots).groupBy("home", "unit").applyInPandas(_within, "a binary, b binary"), "join-within")
    if large.isEmpty():
        return edges
    label = components(edges, "join-first").select(F.col("node").alias("cls"), F.col("root").alias("label"))
    marked = large.select("family", "unit", "units", "cls", "n").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    marked = spool(marked, "join-marked")
    main = marked.groupBy("family", "label").count().groupBy("family").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    others = marked.join(main, "family").where("label != main")
    chunks = others.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / UNIT_SETS), F.ceil(F.sum("n") / UNIT_SHINGLES)).alias("chunks"))
    others = others.join(chunks, "family").withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "cls"), "chunks"))
    each = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("units", "chunks")]
    pairs = marked.join(chunks, "family").select("family", "unit", each[1].alias("chunk"), F.lit(0).alias("side"), "cls", "label").union(
        others.select("family", each[0].alias("unit"), "chunk", F.lit(1).alias("side"), "cls", "label"))
    texts = pairs.join(large.select("cls", "text"), "cls")
    return edges.union(spool(texts.groupBy("family", "unit", "chunk").applyInPandas(_between, "a binary, b binary"), "join-between"))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of each row.

    Two texts link when their sets of distinct word shingles have a Jaccard similarity of at least
    ``PERCENT``; null and wordless texts have an empty set and link with nothing, so they keep their
    own id; rows without an id link like others, and a component without any id has none. Exact
    copies and repeated rows are one set. An empty table gives no rows; other columns play no part,
    whatever their names; texts of any length are taken whole.

    1. Every row gets the size and a 128-bit digest of its set. A sketch of fixed size counts
       shingles, which puts the frequent ones last; this order decides on work alone, not on links.
    2. Sets that link share several of their rarest (100 - ``PERCENT`` + ``CORE``) % shingles. Sets
       connected by such shingles are a family; most sets have none.
    3. The sets of a family are joined by signature trees in one task, many small families in each.
       A family beyond ``UNIT_SETS`` or ``UNIT_SHINGLES`` is dealt over units that share pivot sets;
       what the first round has not joined to the family's main class is then compared with every unit.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *row_key(docs), text)
    found = spool(rows.mapInArrow(_profiles, _PROFILE), "join-profiles")
    profiles = found.where("row is null").select("id", "_k1", "_k2", "n", "cls")
    sketch = np.zeros(SLOTS, np.uint32)
    parts = found.where("row is not null").select("row", "counts").mapInArrow(_fold, "row int, counts binary")
    for r in parts.repartition("row").mapInArrow(_fold, "row int, counts binary").collect():
        sketch[r.row * ROW_SLOTS : (r.row + 1) * ROW_SLOTS] = np.frombuffer(r.counts, "<u4")
    sent = spark.sparkContext.broadcast(sketch)
    families = spool(_families(docs, text, sent), "join-family")
    sent.destroy()

    classes = spool(profiles.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"), F.min(F.struct("_k1", "_k2")).alias("key"), F.first("n").alias("n")), "join-classes")
    chosen = classes.select("cls", "n", "key._k1", "key._k2", F.xxhash64("cls").alias("node")).join(families, "node").select("family", "cls", "n", "_k1", "_k2")
    chosen = spool(_units(spool(chosen, "join-chosen")), "join-units")
    # only rows that may be chosen are shuffled with their text; equal rows share their key, so one of them is kept
    keep = in_bitmap(spark, bitmap(chosen.select(F.col("_k1").alias("h")), bitmap_bits(chosen.count())))
    texts = docs.select(text, *row_key(docs)).where(keep("_k1")).join(chosen, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    sets = spool(texts.drop("_k1", "_k2"), "join-sets")
    roots = components(_links(sets), "join-links")
    named = classes.join(roots, classes.cls == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    named = spool(named, "join-named")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    return profiles.join(named, "cls", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
