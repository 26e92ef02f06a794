"""Log-count ratios and scores against plain counting over strings."""

import math
import random

import numpy as np
import pytest
from callscope.llm import toxicity
from callscope.llm.toxicity import LENGTHS, SLOTS, crc_fold

MASK = 2**64 - 1
MIX = 0x9E3779B97F4A7C15


def plain_slots(text):
    """Slots of all n-grams of letters and digits, a word's ends counting as a character each."""
    out, word = set(), []

    def close():
        marked = [0, *word, 0]
        for n in LENGTHS:
            for a in range(len(marked) - n + 1):
                gram = marked[a : a + n]
                if not word or gram == [0, 0]:
                    continue
                h = gram[0]
                for c in gram[1:]:
                    h = (h * MIX & MASK) ^ c
                h = h * MIX & MASK
                out.add(((h ^ h >> 29) * MIX & MASK) >> 46)
        word.clear()

    for ch in [*(text or ""), " "]:
        low = ch.lower() if len(ch.lower()) == 1 else ch
        if ch.isalpha() or ch.isdigit():
            word.append(ord(low))
        else:
            close()
    return out


def corpus():
    rand = random.Random(2)
    words = ["River", "stone", "naïve", "Straße", "x1", "nitwit", "DUNCE", "blockhead", "a", "quiet", "window-frame", "it's"]
    rows, labels = [], []
    for i in range(260):
        toxic = i % 4 == 0
        pool = words if toxic else [w for w in words if w not in ("nitwit", "DUNCE", "blockhead")]
        rows.append((i, rand.choice([" ".join(rand.choice(pool) for _ in range(rand.randrange(0, 25))), None if i % 50 == 7 else "quiet river"])))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("text", ["Cat dogs", "naïve Straße", "a-b c'd 12", "", None, " .. ", "x" * 50, "İstanbul ǅ"])
def test_slots(text):
    assert set(toxicity.Features.slots(text).tolist()) == plain_slots(text)


def test_ratios_and_scores(spark, monkeypatch):
    rows, labels = corpus()
    seen = {}
    real = toxicity._fit_linear
    monkeypatch.setattr(toxicity, "_fit_linear", lambda sample, ratio, share: seen.update(ratio=ratio, share=share, sample=sample) or real(sample, ratio, share))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, known)
    text, own = dict(rows), [(i, y) for i, y in labels if crc_fold(i) != 0]
    n = [sum(y == k for _, y in own) for k in (0, 1)]
    counts = {}
    for i, y in own:
        for s in plain_slots(text[i]):
            counts.setdefault(s, [0, 0])[y] += 1
    want = np.zeros(SLOTS)
    for s, (zeros, ones) in counts.items():
        if zeros + ones >= 3:
            r = math.log((ones + 1) / (n[1] + 2)) - math.log((zeros + 1) / (n[0] + 2))
            r = math.copysign(max(0.0, abs(r) - math.sqrt(1 / (ones + 1) + 1 / (zeros + 1))), r)
            want[s] = r
    assert seen["ratio"] == pytest.approx(want, abs=1e-12) and (want != 0).any()
    assert seen["share"] == pytest.approx(n[1] / sum(n)) and len(seen["sample"]) == len(own)
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, known).collect()}
    for i, t in rows:
        z = sum(float(weights[s]) for s in plain_slots(t)) + bias
        assert score[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
