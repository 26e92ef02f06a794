"""Posting-list search against brute force."""

import numpy as np
from callscope.llm import neighbours, registry


def brute(rows, k=10, ask=lambda i: True):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in rows:
        if ask(i):
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in rows if j != i and len(w) == len(v))
            yield i, far[:k]


def test_edge_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (10, [1.0]), (11, [-1.0, 0.0]),
            (None, [1.0, 1.0]), (12, [0.0, -1.0])] + [(100 + i, [1.0, 0.0]) for i in range(40)]
    vectors = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, id int")
    index = neighbours.build_index(vectors)
    got = neighbours.search(index, neighbours.usable(vectors)).collect()
    want = dict(brute([r for r in rows if not r[1] or len(r[1]) == 2]))
    for i, far in want.items():
        own = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == i)
        assert [(s, j) for _, s, j in own] == far and [r for r, _, _ in own] == list(range(1, len(far) + 1))
    assert {r.query_id for r in got} == set(want)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.search(neighbours.build_index(empty), neighbours.usable(empty)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert neighbours.search(neighbours.build_index(one), neighbours.usable(one)).count() == 0


def test_graph_finds_the_nearest():
    random = np.random.default_rng(4)
    points = random.normal(size=(900, 12))
    graph = neighbours.CentroidGraph(points)
    queries = random.normal(size=(300, 12))
    near, d = graph.nearest(queries, 8)
    true = np.argsort(((points[None] - queries[:, None]) ** 2).sum(2), 1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(near, true, strict=True)]) > 0.9
    assert (np.diff(d, axis=1) >= 0).all()


def test_lists_are_balanced():
    sample = np.random.default_rng(5).normal(size=(4000, 8)) * [50, 1, 1, 1, 1, 1, 1, 1]
    assert len(neighbours.balanced_centroids(sample, 64)) == 64


def test_every_dimension_is_searched(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(40)] + [(100 + i, [float(i), 2.0]) for i in range(9)] + [(200, [1.0])]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 2 = 0", 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = {i: far for i, far in brute(rows, 3, lambda i: i % 2 == 0) if far}
    assert {i: [(s, j) for _, s, j in sorted(v)] for i, v in got.items()} == want


def test_the_ratio_alone_decides():
    points = np.random.default_rng(3).normal(size=(500, 6))
    graph = neighbours.CentroidGraph(points)
    queries = np.random.default_rng(4).normal(size=(40, 6))
    r, c = graph.within(queries, 3.0)
    d = np.sqrt(((points[None] - queries[:, None]) ** 2).sum(2))
    inside = d <= 3.0 * d.min(1, keepdims=True)
    got = np.zeros_like(inside)
    got[r, c] = True
    assert inside.sum(1).max() > 64 and (got & inside).sum() >= 0.99 * inside.sum() and not (got & ~inside).any()


def test_a_query_beside_a_small_list_still_finds_ten(spark):
    """A few vectors far from all others make a list of their own, which holds fewer than are asked for."""
    random = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(3000, 4)))] + [(5000 + i, [60 + i / 10, 60.0, 60.0, 60.0]) for i in range(3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(neighbours.build_index(vectors), neighbours.usable(vectors).where("id >= 5000 or id % 500 = 0")).groupBy("query_id").count().collect()
    assert len(got) == 9 and all(r["count"] == 10 for r in got)


def test_few_vectors_are_copied_and_read(spark):
    """Copies and the share of all vectors that queries read, at a recall of 0.9 and more."""
    vectors = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    index = neighbours.build_index(vectors)
    n = index.members.select("h1", "h2").distinct().count()
    sizes = {r["list"]: r["count"] for r in index.postings.groupBy("list").count().collect()}
    asked = neighbours.usable(vectors).where("id % 100 = 0")
    read = [sum(sizes.get(x, 0) for x in r.lists) for r in neighbours.probes(index, asked).collect()]
    copies, share = sum(sizes.values()) / n, sum(read) / asked.count() / n
    print(f"copies {copies:.2f}, share of brute force {share:.2f}, ratio {index.ratio:.3f}")
    assert copies < 2 and share < 0.75


def test_recall_and_blocks(spark, monkeypatch):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(neighbours, "LIST_SIZE", 32)
    got = {}
    for r in registry.op5_neighbours(spark, path).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = dict(brute(rows, ask=lambda i: i % 100 == 0))
    assert set(got) == set(want)
    found = [j in got[i] for i, far in want.items() for _, j in far]
    assert np.mean(found) >= 0.9
    for i, far in want.items():
        assert all(got[i].get(j, s) == s or abs(got[i][j] - s) < 1e-12 for s, j in far) and len(got[i]) == 10
