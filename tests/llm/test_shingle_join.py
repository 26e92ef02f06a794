"""The signature-tree join against plain comparison of all pairs."""

import random
import re

import numpy as np
import pytest
from callscope.llm import registry, shingle_join


def plain_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    by, parent = {}, list(range(len(rows)))
    for k, s in enumerate(sets):
        for w in s:
            by.setdefault(w, []).append(k)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        shared = {}
        for w in s:
            for j in by[w]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                x, y = top(j), top(k)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def texts(seed, families=14, copies=9):
    rand = random.Random(seed)
    out = [None, "", " \t\n", "One", "one", "one two three", "one  two\x0bthree", "one two three four", "É é", "x " * 9000, "x " * 9001, "X X X"]
    passage = [rand.choice("abcdefgh") * rand.randrange(1, 5) for _ in range(30)]
    for _ in range(families):
        words = [f"w{rand.randrange(4000)}" for _ in range(rand.randrange(5, 300))]
        for _ in range(rand.randrange(1, copies)):
            text = list(words)
            for _ in range(rand.choice([0, 0, 1, 2, 5, 9])):
                text[rand.randrange(len(text))] = f"n{rand.randrange(4000)}"
            if rand.random() < 0.3:
                text += passage[: rand.randrange(31)]
            if rand.random() < 0.2:
                text = text[rand.randrange(9) :] or text
            out.append(rand.choice([str, str.upper, str])(" ".join(text)))
    return [(k, t) for k, t in enumerate(out)]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "doc_id long, text string, cls string, _k1 int, id binary").repartition(3)
    return sorted((tuple(r) for r in shingle_join.join_documents(docs).collect()), key=str)


def test_small_families(spark):
    rows = texts(1)
    rows += [(None, rows[-1][1]), (None, "nobody else has this text at all"), (3, "one"), (3, "one")]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_large_families_are_dealt_over_units(spark, monkeypatch, hot):
    monkeypatch.setattr(shingle_join, "UNIT_SETS", 6)
    monkeypatch.setattr(shingle_join, "PIVOTS", 2)
    monkeypatch.setattr(shingle_join, "HOT", hot)
    rows = texts(2, families=5, copies=40)
    assert run(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("leaf", [1, 2, 16])
def test_trees_lose_no_link(monkeypatch, leaf):
    """All links of random sets are found as classes, within a tree and between two, whatever the bitmaps' size."""
    monkeypatch.setattr(shingle_join, "LEAF", leaf)
    rand = np.random.default_rng(leaf)
    sets = []
    for _ in range(25):
        base = rand.integers(0, 2**63, rand.integers(1, 200)).astype(np.uint64)
        for _ in range(rand.integers(1, 8)):
            keep = base[rand.random(len(base)) > rand.choice([0, 0.03, 0.1])]
            sets.append(np.unique(np.concatenate([keep, rand.integers(0, 2**63, rand.integers(1, 8)).astype(np.uint64)])))
    sets = [sets[k] for k in shingle_join.tree_order(sets)]

    def classes(pairs):
        root = np.arange(len(sets))
        for p, q in pairs:
            root[root == max(root[p], root[q])] = min(root[p], root[q])
        return root.tolist()

    plain_links = [(p, q) for p in range(len(sets)) for q in range(p) if shingle_join._linked(sets[p], sets[q])]
    want = classes(plain_links)
    for bits in (256, 4096):
        tree = shingle_join.Tree(sets, bits)
        assert classes(shingle_join.join_trees(tree, tree, np.arange(len(sets)), 0, 0)) == want
        half = len(sets) // 2
        x, y = shingle_join.Tree(sets[:half], bits), shingle_join.Tree(sets[half:], bits)
        found = [(p, half + q) for p, q in shingle_join.join_trees(x, y, np.arange(len(sets)), 0, half)]
        assert classes(found) == classes([(p, q) for p, q in plain_links if (p < half) != (q < half)])


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = registry.op13_shingle_join(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in docs])
