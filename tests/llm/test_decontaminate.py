"""FM-index search against plain window matching."""

import hashlib
import random
import re

import numpy as np
import pytest
from callscope.llm import decontaminate, fm_index, registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).update([] if name is None else [str(name)])
    for name, text in docs:
        w, own = words(text), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    own |= found
                    hit[k : k + n] = [True] * n
        yield name, len(w), [i for i, h in enumerate(hit) if h], sorted(own)


def result(rows):
    return sorted(((str(r.doc_id), r.n_words, [i for s in r.spans for i in range(s.start, s.end)], r["items"]) for r in rows), key=str)


def same(rows, docs, items):
    assert result(rows) == sorted(((str(n), *x) for n, *x in brute(docs, items)), key=str)


@pytest.mark.parametrize("size", [2, 3, 9])
def test_index_counts_and_places(size):
    random_ = np.random.default_rng(size)
    text = random_.integers(0, size, 700)
    text[0] = text[-1] = 0
    index = fm_index.FmIndex(text.astype(np.int32), size)
    patterns = random_.integers(1, size, (60, 4)) if size > 1 else np.ones((1, 4))
    lengths = random_.integers(1, 5, 60)
    low, high = index.search(patterns.astype(np.int32), lengths)
    for p, n, a, b in zip(patterns, lengths, low, high, strict=True):
        want = [i for i in range(700 - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_edge_rows(spark, monkeypatch):
    rand = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "x²", "ñ"]
    text = lambda n: " ".join(rand.choice(vocabulary) for _ in range(n))
    passage = text(40)
    items = [(1, passage), (2, passage.upper()), (2, passage), (3, "w1 w2"), (4, None), (5, "... --"), (None, "w3 w4 w5"), (10, "W7"), (11, text(9))]
    docs = [(1, None), (2, ""), (3, "-- .."), (None, "a " + passage), (5, passage + " x " + passage), (5, passage + " x " + passage), (6, (text(3000) + " " + passage + ", ") * 5), (7, "w7"), (8, "clean words only")]
    docs += [(100 + i, text(rand.randrange(30))) for i in range(40)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, spans int, items int")
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_leaks(frame, bench).collect()
    same(got, docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)  # more than one block, then more than one pass
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    same(decontaminate.find_leaks(frame, bench).collect(), docs, items)
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0
    none = decontaminate.find_leaks(frame, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.spans for r in none)


def test_remove(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    item = "a b c d e f g h i j"
    # the cut brings the second item's halves together, which then go too
    docs = [(1, f"Before it. {passage.title()}! After it."), (2, f"a b c d e {passage} f g h i j"), (3, None), (4, "clean"), (4, "clean"), (5, "")]
    frame = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in docs], "doc_id long, text string, n_chars long, spans string")
    bench = spark.createDataFrame([(1, passage), (2, item)], "item_id long, text string")
    got = decontaminate.remove_leaks(frame, bench)
    assert got.columns == frame.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "Before it. ! After it." and rows[1].n_chars == len(rows[1].text)
    assert words(rows[2].text) == [] and rows[3].text is None and rows[4].text == "clean" and rows[5].text == ""
    assert got.count() == 6
    assert decontaminate.remove_leaks(frame, bench.limit(0)).count() == 6


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    want = {n: (n_words, len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit)) for n, n_words, hit, own in brute(docs, items)}
    got = registry.op2_decontaminate(spark, path).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert any(r.contaminated for r in got)
