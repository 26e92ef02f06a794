"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from callscope.llm import phrases


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, " ".join(words[i : i + k])] += 1
    return f, n


def plain(rows, least, top):
    f, n = plain_counts(rows)
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        longer = {p: a for (x, p), a in f.items() if x == lang and " " in p}
        found = []
        for p, a in longer.items():
            w = p.split(" ")
            if any(b >= a and len(q) > len(p) and f" {p} " in f" {q} " for q, b in longer.items()):
                continue
            cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
            score, left, right = min(((1000 * a * n[lang] // (x * y), x, y) for x, y in cuts), key=lambda c: c[0])
            found.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n):
    rand = random.Random(seed)
    words = ["a", "b", "New", "york", "É", "x\x00y", "the", "of", "z\x0b", " "]
    rows = []
    for _ in range(n):
        text = "".join(rand.choice(words) + rand.choice([" ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rand.randrange(40)))
        rows.append((rand.choice(["en", "de", None, "und"]), rand.choice([text, text, text + " one fixed phrase of words", None, ""])))
    return rows


@pytest.mark.parametrize("least,top", [(3, 2000), (6, 7)])
def test_collocations(spark, least, top):
    rows = texts(least, 400) + [("en", "very long " * 3000)] + [("fr", "same row twice")] * 9
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, k int").repartition(5)
    got = phrases.collocations(docs, min_count=least, top=top).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, top)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "too few"), ("en", None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("slots", [1, 16, 256])
def test_shared_slots_change_nothing(spark, monkeypatch, slots):
    """A table so small that most phrases share slots opens cycles early, but counts stay whole."""
    whole = phrases.bitmap

    def folded(hashes, bits):
        found = np.unpackbits(whole(hashes, 1 << 15), bitorder="little").reshape(-1, bits).any(0)
        return np.packbits(np.pad(found, (0, -bits % 8)), bitorder="little")

    monkeypatch.setattr(phrases, "bitmap", folded)
    monkeypatch.setattr(phrases, "LEAST_SLOTS", slots)
    monkeypatch.setattr(phrases, "MOST_SLOTS", slots)
    rows = texts(slots, 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = {(r.lang, bytes(r.phrase).decode()): r.f for r in phrases.count_phrases(docs, min_count=2).collect()}
    assert got == {k: v for k, v in plain_counts(rows)[0].items() if v >= 2}


@pytest.mark.parametrize("words,size", [(1, 1), (7, 3), (50, 1 << 22), (1 << 21, 5)])
def test_blocks_lose_no_phrase(monkeypatch, words, size):
    """Blocks of any size, cut within texts, hold every occurrence once; with every slot taken all phrases are counted in one cycle."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", words)
    monkeypatch.setattr(phrases, "SLICE", size)
    rows = [(lang or "und", text or "") for lang, text in texts(words, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows], pa.binary())], names=["lang", "text"])
    got = Counter()
    for block in phrases._blocks(iter([batch])):
        row = block.to_pylist()[0]
        for counts in phrases._count(row["lang"], row["words"], row["ids"], 2, 3, np.ones(1, np.uint8)):
            for r in counts.to_pylist():
                got[r["lang"], r["phrase"].decode()] += r["f"]
                assert r["done"] == 3 + (" " in r["phrase"].decode())
    assert got == plain_counts(rows)[0]
