"""SimHash trees against plain all-pairs comparison."""

import random
import re

import numpy as np
import pytest
import xxhash
from callscope.llm import registry, simhash
from callscope.llm.common import components


def plain_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, bits):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", "  \t\n", "One", "one two", "A b  C d e\x0bf É", "x " * 9000, "the same words the same words"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_edge_rows(spark):
    rand = random.Random(2)
    base = [" ".join(rand.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(12)]
    texts = [None, "", " ", "one", "one", *base, *base[:4], *[b + " tail" for b in base], *[b.replace("aaa", "bbb", 1) for b in base]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, base[0]), (None, "alone in its group"), (None, "alone in its group"), (None, "a second group without any id at all")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    prints = [plain_print(t) for _, t in rows]
    classes = plain_classes(prints, 2)
    least = {c: min((i for (i, _), k in zip(rows, classes, strict=True) if k == c and i is not None), default=None) for c in classes}
    want = sorted(((i, f, least[c]) for (i, _), f, c in zip(rows, prints, classes, strict=True)), key=str)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_shards_lose_no_link(spark, monkeypatch, bits):
    random_ = np.random.default_rng(bits)
    far = random_.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + random_.integers(0, 2, 300, dtype=np.uint64)
    near = far[:120, None] ^ (np.uint64(1) << random_.integers(0, 64, (120, 4), dtype=np.uint64))  # chains and a dense ball
    ball = far[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    prints = np.unique(np.concatenate([far, near.ravel(), ball, [np.uint64(0), np.uint64(2**64 - 1)]]))
    monkeypatch.setattr(simhash, "SHARD_PRINTS", 32)
    monkeypatch.setattr(simhash, "LEAF", 4)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.link_prints(frame, bits).collect()}
    classes = plain_classes([int(p) for p in prints], bits)
    groups, want = {}, {}
    for p, c in zip(prints.view(np.int64).tolist(), classes, strict=True):
        groups.setdefault(c, []).append(p)
    for g in groups.values():
        if len(g) > 1:
            want |= dict.fromkeys(g, min(g))
    assert got == want


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(30)]
    edges = spark.createDataFrame([*path, *star, (229, 500), (7, 7), (900, 900), (-5, 300), (300, -5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, *range(200, 230), 500)} | {-5: -5, 300: -5}
    assert components(edges.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(r.text) for r in docs]
    want = [(r.doc_id, f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, plain_classes(prints, 2), strict=True)]
    assert sorted(tuple(r) for r in registry.op9_simhash(spark, "/root/testdata/sf0.001").collect()) == want
