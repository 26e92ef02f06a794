"""Approximate nearest neighbours with balanced posting lists.

Vectors are clustered into lists of about equal size; a vector near a border is copied to
several lists. The lists' centroids form a graph in memory, searched greedily for the
nearest lists of a query; those far beyond the nearest are pruned by distance ratio. The
candidates of the lists left are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import partitions, prepare, spool

#: Distinct vectors that a list is meant to hold, most centroids, and bytes and rows of the sample (a documented bound) that they are fitted to.
LIST_SIZE, MAX_LISTS, SAMPLE_BYTES, SAMPLE = 32, 8192, 64 << 20, 40_000
#: Rounds that refine the centroids.
ROUNDS = 6
#: A border vector is copied to at most COPIES lists, those within COPY_RATIO of its nearest centroid's distance.
COPIES, COPY_RATIO = 4, 1.005
#: A query reads the lists within a ratio of its nearest centroid's distance (or of the median such distance, if that is larger):
#: the least ratio with which QUERIES vectors of the sample find this share of their neighbours among all vectors; and at least
#: the nearest lists that hold so many times the vectors that it asks for.
TARGET, QUERIES, LEAST = 0.93, 256, 8
#: Neighbours in the centroid graph, the least beam of its search, and nodes of a beam opened at a time.
DEGREE, BEAM, OPEN = 24, 32, 4
#: Lists that stand together in a group, and rows of postings and queries of a group that one task holds; more are cut into blocks.
GROUP, BLOCK_ROWS, BLOCK_QUERIES = 16, 4096, 2048


def balanced_centroids(sample: np.ndarray, n_lists: int) -> np.ndarray:
    """Centroids by repeated halving (each part is split in two equal halves along its two-means direction), refined by
    ``ROUNDS`` rounds of k-means. Neighbouring numbers stand for neighbouring parts."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    random = np.random.default_rng(7)
    parts = [np.arange(len(sample))]
    while len(parts) < n_lists:
        largest = max(range(len(parts)), key=lambda k: len(parts[k]))
        part = parts[largest]
        if len(part) < 2:
            break
        x = sample[part]
        a, b = x[random.choice(len(x), 2, replace=False)]
        for _ in range(6):
            side = x @ (a - b)
            near = side >= np.median(side)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        order = np.argsort(x @ (a - b), kind="stable")
        parts[largest : largest + 1] = [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    centroids = np.array([sample[p].mean(0) for p in parts])
    for _ in range(ROUNDS):
        norms, sums, held = (centroids**2).sum(1), np.zeros_like(centroids), np.zeros(len(centroids))
        for a in range(0, len(sample), 2048):
            own = np.argmin(norms - 2 * sample[a : a + 2048] @ centroids.T, axis=1)
            np.add.at(sums, own, sample[a : a + 2048])
            held += np.bincount(own, minlength=len(centroids))
        centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
    return centroids


class CentroidGraph:
    """Each centroid's nearest others (and some far ones), searched best first for many points at once."""

    def __init__(self, centroids: np.ndarray):
        self.points = centroids
        n = len(centroids)
        self.norms = (centroids**2).sum(1)
        degree = min(DEGREE, max(0, n - 1))
        self.edges = np.zeros((n, degree), np.int64)
        random = np.random.default_rng(11)
        for a in range(0, n, 512):
            d = self.norms - 2 * centroids[a : a + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            if degree:
                self.edges[a : a + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        if n > 4 * DEGREE:  # some long edges, so that no part of the graph is cut off
            self.edges[:, -4:] = random.integers(0, n, (n, 4))
        self.entry = random.permutation(n)[: min(n, 32)]

    def nearest(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, distance) of about the k nearest centroids of each query, nearest first."""
        n, k = len(self.points), min(k, len(self.points))
        beam = min(n, max(beam, k + k // 4))
        out_i, out_d = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
        for a in range(0, len(queries), 256):
            out_i[a : a + 256], out_d[a : a + 256] = self._search(queries[a : a + 256], k, beam)
        return out_i, out_d

    def within(self, queries: np.ndarray, ratio: float, floor: float = 0.0, sizes: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, centroid) for every centroid within ``ratio`` times the nearest one's distance (``floor`` at least), and
        the nearest ones until lists of these ``sizes`` hold ``least`` vectors.

        A search that ends within that is made again with twice the centroids, so no number of them decides.
        """
        rows, found, left, k = [], [], np.arange(len(queries)), min(64, len(self.points))
        while len(left) and k:
            near, d = self.nearest(queries[left], k)
            inside = d <= (np.maximum(d[:, :1], max(floor, 1e-12)) * ratio if np.isfinite(ratio) else np.inf)
            if sizes is not None:
                held = np.cumsum(sizes[near], axis=1)
                inside |= held - sizes[near] < least
            ended = ~inside[:, -1] | (k == len(self.points))
            r, c = np.nonzero(inside & ended[:, None])
            rows.append(left[r])
            found.append(near[r, c])
            left, k = left[~ended], min(2 * k, len(self.points))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found))

    def _search(self, q: np.ndarray, k: int, beam: int):
        """Best first: each step opens the nearest unopened nodes of every query's beam."""
        n, qq = len(self.points), (q**2).sum(1)
        node = np.tile(self.entry, (len(q), 1))
        d = qq[:, None] + self.norms[self.entry] - 2 * q @ self.points[self.entry].T
        opened, seen = np.zeros(d.shape, bool), np.zeros((len(q), n), bool)
        seen[:, self.entry] = True
        while True:
            ahead = np.where(opened, np.inf, d)
            step = np.argpartition(ahead, min(OPEN, d.shape[1]) - 1, axis=1)[:, :OPEN]
            r, c = np.nonzero(np.isfinite(np.take_along_axis(ahead, step, 1)))
            if not len(r):
                break
            at = step[r, c]
            opened[r, at] = True
            key = np.unique((r[:, None] * n + self.edges[node[r, at]]).ravel())
            r, new = key // n, key % n
            fresh = ~seen[r, new]
            r, new = r[fresh], new[fresh]
            seen[r, new] = True
            number = np.bincount(r, minlength=len(q))
            place = np.arange(len(r)) - np.repeat(np.cumsum(number) - number, number)
            more = np.full((len(q), int(number.max(initial=0))), np.inf)
            names = np.zeros(more.shape, np.int64)
            more[r, place] = qq[r] + self.norms[new] - 2 * np.einsum("ij,ij->i", q[r], self.points[new])
            names[r, place] = new
            d, node = np.concatenate([d, more], 1), np.concatenate([node, names], 1)
            opened = np.concatenate([opened, np.isinf(more)], 1)
            if d.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                d, node, opened = (np.take_along_axis(x, keep, 1) for x in (d, node, opened))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        d, node = np.take_along_axis(d, order, 1), np.take_along_axis(node, order, 1)
        if d.shape[1] < k:  # a part of the graph out of reach: those lists are not found
            d = np.pad(d, ((0, 0), (0, k - d.shape[1])), constant_values=np.inf)
            node = np.pad(node, ((0, 0), (0, k - node.shape[1])))
        return node, np.sqrt(np.maximum(d, 0))


def _lists_of(graph: CentroidGraph, x: np.ndarray) -> np.ndarray:
    """The lists that hold each vector, padded with -1."""
    out = np.full((len(x), COPIES), -1)
    for a in range(0, len(x), 4096):
        near, d = graph.nearest(x[a : a + 4096], COPIES)
        out[a : a + 4096, : near.shape[1]] = np.where(d <= np.maximum(d[:, :1] * COPY_RATIO, 1e-12), near, -1)
    return out


def calibrated(distinct: DataFrame, sample: np.ndarray, graph: CentroidGraph, k: int = 10) -> tuple[float, float]:
    """(ratio, floor): the least distance ratio at which sampled queries find ``TARGET`` of their k nearest of all vectors, and
    the median distance of a nearest centroid. Infinite (all lists are read) if there is one list.

    The queries are compared with all vectors in tasks, each of which returns the nearest of its part.
    """
    if len(sample) < 2 or len(graph.points) < 2:
        return float("inf"), 0.0
    ask = sample[:: max(1, len(sample) // QUERIES)]
    d = np.sqrt(np.maximum((ask**2).sum(1)[:, None] + graph.norms - 2 * ask @ graph.points.T, 0))
    floor = float(np.median(d.min(1)))

    def nearest(frames):
        for frame in frames:
            x = _matrix(frame.v)
            for a in range(0, len(x), 2048):
                y = x[a : a + 2048]
                far = (y**2).sum(1) - 2 * ask @ y.T + (ask**2).sum(1)[:, None]
                own = np.argsort(far, axis=1)[:, : k + 1]
                q = np.repeat(np.arange(len(ask)), own.shape[1])
                yield pd.DataFrame({"q": q, "far": np.take_along_axis(far, own, 1).ravel(), "v": frame.v.to_numpy()[a + own.ravel()]})

    place = F.row_number().over(W.partitionBy("q").orderBy("far", "v"))
    found = distinct.select("v").mapInPandas(nearest, "q long, far double, v array<double>").withColumn("place", place).where(f"place between 2 and {k + 1}").toPandas()
    own = np.concatenate([d / np.maximum(d.min(1, keepdims=True), max(floor, 1e-12)), np.full((len(ask), 1), np.inf)], 1)
    needed = np.sort(own[found.q.to_numpy()[:, None], _lists_of(graph, _matrix(found.v))].min(1))
    return float(needed[int(np.ceil(TARGET * len(needed))) - 1]) * (1 + 1e-9), floor


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` (long) and ``v`` (array of double) of the vectors that take part.

    Those that are null, empty or zero, or hold a null or non-finite component, and rows without an
    id, are left out.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return rows.where(F.col("id").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


class Index:
    """Posting lists (``list``, ``h1``, ``h2``, ``v``) of distinct vectors, their rows (``h1``, ``h2``, ``id``), and the centroid graph."""

    def __init__(self, graph, postings: DataFrame, members: DataFrame, dim: int, ratio: float, floor: float, sizes: np.ndarray):
        self.graph, self.postings, self.members, self.dim = graph, postings, members, dim
        self.ratio, self.floor, self.sizes = ratio, floor, sizes


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def dimensions(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> list[int]:
    """Dimensions of the usable vectors, the commonest first."""
    rows = usable(vectors, id_col, vector_col).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").collect()
    return [r.dim for r in rows]


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> Index:
    """Index every usable row of one dimension (None: the commonest, the smaller of ties).

    Equal vectors are one posting with all their ids as members, so thousands of copies of a
    vector fill no list; repeated rows are one row. The centroids are fitted to the distinct vectors
    with the smallest hashes, about ``SAMPLE`` of them and ``SAMPLE_BYTES`` at most; all are then placed by
    a search of the graph. Extra columns play no part, whatever their names; a table without usable
    rows gives an index that finds nothing.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, id_col, vector_col)
    dim = dim or next(iter(dimensions(vectors, id_col, vector_col)), 1)
    rows = rows.where(F.size("v") == dim)
    members = spool(rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v").distinct(), "vectors")
    distinct = spool(members.groupBy("h1", "h2").agg(F.first("v").alias("v")), "vectors-distinct")
    n = distinct.count()
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dim)))
    # hashes are even, so a bound on them gives about as many as wanted, and no task sends more than its part
    chosen = distinct if n <= most else distinct.where(F.col("h1") < F.lit(-(1 << 63) + (most << 64) // n))
    sample = _matrix(chosen.select("h1", "h2", "v").toPandas().sort_values(["h1", "h2"]).v)
    n_lists = int(min(MAX_LISTS, max(1, n // LIST_SIZE), max(1, len(sample) // 8)))
    centroids = CentroidGraph(balanced_centroids(sample, n_lists))
    ratio, floor = calibrated(distinct, sample, centroids)
    graph = spark.sparkContext.broadcast(centroids)

    def place(frames):
        for frame in frames:
            if not len(frame):
                continue
            near, d = graph.value.nearest(_matrix(frame.v), COPIES)
            r, c = np.nonzero(d <= np.maximum(d[:, :1] * COPY_RATIO, 1e-12))
            yield pd.DataFrame({"list": near[r, c], "h1": frame.h1.to_numpy()[r], "h2": frame.h2.to_numpy()[r], "v": frame.v.to_numpy()[r]})

    postings = spool(distinct.mapInPandas(place, "list long, h1 long, h2 long, v array<double>"), "postings")
    sizes = np.zeros(max(1, len(centroids.points)), np.int64)
    for r in postings.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    return Index(graph, postings, members.select("id", "h1", "h2"), dim, ratio, floor, sizes)


def probes(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """``grp`` (of ``GROUP`` lists), ``id``, ``v``, ``lists``: the lists that each query reads, a row for each group of them."""
    graph, ratio, floor, sizes = index.graph, index.ratio, index.floor, index.sizes

    def probe(frames):
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = frame.iloc[a : a + 256]
                r, found = graph.value.within(_matrix(part.v), ratio, floor, sizes, LEAST * (k + 1))
                if not len(r):
                    continue
                pairs = pd.DataFrame({"r": r, "grp": found // GROUP, "lists": found}).groupby(["r", "grp"]).lists.apply(list).reset_index()
                yield pd.DataFrame({"grp": pairs.grp.astype(np.int64), "id": part.id.to_numpy()[pairs.r], "v": part.v.to_numpy()[pairs.r], "lists": pairs.lists})

    return queries.mapInPandas(probe, "grp long, id long, v array<double>, lists array<long>")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest indexed rows of each query: ``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance).

    ``queries`` has ``id`` and ``v`` (as from ``usable``; other dimensions find nothing); a query's own id is no
    candidate. Nearest first, ties to the smaller id. A task holds a block of a group's postings and
    a block of the queries that read lists of it; it returns the k + 1 nearest distinct vectors that
    each query finds there, and ties.
    """
    # ids of one vector that can be among k results: its k + 1 smallest
    own = W.partitionBy("h1", "h2").orderBy("id")
    ids = index.members.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1).drop("r")
    asked = spool(queries.where(F.size("v") == index.dim).select("id", "v").distinct(), "queries")
    sent = spool(probes(index, asked.repartition(partitions(index.members.sparkSession), "id"), k), "probes")

    def blocks(rows, size, name):
        return rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias(name))

    # blocks of a group's postings go to all blocks of its queries, and the other way round
    posts = index.postings.withColumn("grp", F.floor(F.col("list") / GROUP))
    sizes = spool(blocks(posts, BLOCK_ROWS, "blocks").join(blocks(sent, BLOCK_QUERIES, "parts"), "grp"), "group-sizes")
    each = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("blocks", "parts")]
    posts = posts.join(sizes, "grp").withColumn("block", F.pmod("h2", "blocks")).withColumn("part", each[1]).drop("blocks", "parts")
    sent = sent.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("block", each[0]).drop("blocks", "parts")

    def compare(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "h1": [], "h2": [], "score": []}
        if len(block) and len(ask):
            x, q, lists = _matrix(block.v), _matrix(ask.v), block.list.to_numpy()
            names, h1, h2 = ask.id.to_numpy(), block.h1.to_numpy(), block.h2.to_numpy()
            asked_by: dict[int, list[int]] = {}
            for i, own in enumerate(ask.lists):
                for one in own:
                    asked_by.setdefault(int(one), []).append(i)
            for one, who in asked_by.items():
                at, who = np.flatnonzero(lists == one), np.array(who)
                if not len(at):
                    continue
                y = x[at]
                d = (y**2).sum(1) - 2 * q[who] @ y.T + (q[who] ** 2).sum(1)[:, None]
                best = min(k + 1, len(at))
                # every vector that can be among the k + 1 nearest, ties and rounding included; then the exact distance
                last = np.partition(d, best - 1, axis=1)[:, best - 1]
                r, c = np.nonzero(d <= (last + 1e-9 * (1 + (y**2).sum(1).max() + (q[who] ** 2).sum(1)))[:, None])
                out["query_id"].append(who[r])
                out["h1"].append(h1[at[c]])
                out["h2"].append(h2[at[c]])
                out["score"].append(np.sqrt(((y[c] - q[who[r]]) ** 2).sum(1)))
        found = pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})
        if len(found):  # of all lists of the block, the k + 1 nearest of each query
            found = found.drop_duplicates(["query_id", "h1", "h2"])
            found = found[found.groupby("query_id").score.rank(method="min") <= k + 1]
            found["query_id"] = names[found.query_id.to_numpy()]
        return found

    near = posts.groupBy("grp", "block", "part").cogroup(sent.groupBy("grp", "block", "part")).applyInPandas(compare, "query_id long, h1 long, h2 long, score double")
    near = near.groupBy("query_id", "h1", "h2").agg(F.min("score").alias("score"))
    # distinct vectors first (with ties of the last), then their rows
    by = W.partitionBy("query_id").orderBy("score")
    near = near.withColumn("r", F.rank().over(by)).where(F.col("r") <= k + 1).drop("r")
    rows = near.join(ids, ["h1", "h2"]).where("id != query_id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: str, k: int = 10) -> DataFrame:
    """``search`` for the usable rows that the condition ``queries`` (on ``id``) names, in an index of each dimension there is.

    Only vectors of one dimension have a distance, so each query is compared with those of its own.
    """
    found = [search(build_index(vectors, dim=dim), usable(vectors).where(queries), k) for dim in dimensions(vectors) or [1]]
    out = found[0]
    for one in found[1:]:
        out = out.union(one)
    return out
