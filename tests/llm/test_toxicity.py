"""Toxicity classifier: held-out accuracy, determinism and edge rows."""

import numpy as np
import pytest
from callscope.llm import registry, toxicity
from callscope.llm.toxicity import SLOTS, Features, crc_fold


def test_features_mark_word_ends():
    assert set(Features.slots("Cat")) == set(Features.slots("cat")) == set(Features.slots(" cat... "))
    assert set(Features.slots("cat")) != set(Features.slots("cats"))
    assert set(Features.slots("cat dog")) == set(Features.slots("cat")) | set(Features.slots("dog"))  # no n-gram goes over a gap
    assert len(Features.slots(None)) == len(Features.slots("")) == len(Features.slots(" .. ")) == 0
    words = [f"w{i}x" for i in range(90_000)]  # longer than a chunk: nothing is lost at its border
    long, parts = set(Features.slots(" ".join(words))), set()
    for a in range(0, len(words), 1000):
        parts |= set(Features.slots(" ".join(words[a : a + 1000])))
    assert long == parts


def corpus(spark):
    rand = np.random.default_rng(1)
    mild = ["calm", "river", "stone", "green", "paper", "window", "early", "quiet"]
    rude = ["blockhead", "nitwit", "dunce"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [str(rand.choice(mild)) for _ in range(int(rand.integers(3, 40)))] + [str(rand.choice(rude))] * toxic
        rand.shuffle(words)
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_and_edge_rows(spark):
    rows, labels = corpus(spark)
    odd = [(None, "calm nitwit", 1), (9001, None, 1), (9002, "", 1), (9003, "river " * 50_000 + "dunce", 1), (1, rows[1][1], 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic int")
    known = spark.createDataFrame([*labels, (None, 1), (9001, 0), (9002, None), (3, 0), (5_000_000, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, known).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for i, toxic in labels:
        assert by[i].predicted == toxic and by[i].held_out == (crc_fold(i) == 0)
        assert 0 <= by[i].score <= 1 and by[i].predicted == int(by[i].score >= 0.5)
    assert by[None].predicted == 1 and by[None].held_out is False
    assert by[9001].score == by[9002].score < 0.5
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    # a held-out row's label changes nothing
    turned = spark.createDataFrame([(i, 1 - t if crc_fold(i) == 0 else t) for i, t in labels], "doc_id long, toxic int")
    a = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    b = {r.doc_id: r.score for r in toxicity.score_documents(docs, turned).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, none)
    assert not weights.any() and len(weights) == SLOTS and bias == 0
    assert toxicity.score_documents(docs.limit(0), none).count() == 0
    assert toxicity.score_documents(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).first().predicted == 0


def test_query_beats_chance_far(spark):
    path = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [r for r in registry.op10_toxicity(spark, path).collect() if r.held_out and r.doc_id in labels]
    right = np.mean([r.predicted == labels[r.doc_id] for r in got])
    found = np.mean([r.predicted for r in got if labels[r.doc_id] == 1])
    assert right > 0.97 and found > 0.8
