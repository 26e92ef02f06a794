"""The whole pipeline over all documents of a given size against plain versions of its stages."""

import base64
import hashlib
import math

import corpus_pipeline
import public_tokenizers
import tiktoken
from callscope.llm import toxicity
from test_decontaminate import brute, words
from test_simhash import plain_classes, plain_print
from test_substring_dedup import plain as without_repeats
from test_toxicity_plain import plain_slots

PATH = "/root/testdata/sf0.01"


def without_leaks(text, items):
    """Words left when all hit words went, again and again."""
    left = words(text)
    while True:
        (_, _, hit, _), = brute([(0, " ".join(left))], items)
        if not hit:
            return left
        left = [w for k, w in enumerate(left) if k not in set(hit)]


def test_every_stage(spark):
    table = lambda name: spark.read.parquet(f"{PATH}/{name}.parquet")
    stage = dict(corpus_pipeline.STAGES)
    spooled = lambda df: spark.createDataFrame(df.collect(), df.schema)
    docs = table("documents")

    weights, bias = toxicity.fit(docs, table("labels"))
    mild = {r.doc_id for r in docs.collect() if 1 / (1 + math.exp(-(sum(float(weights[s]) for s in plain_slots(r.text)) + bias))) < 0.5}
    docs = spooled(stage["toxicity"](spark, docs, PATH))
    assert {r.doc_id for r in docs.collect()} == mild and 0 < len(mild) < table("documents").count()

    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    classes = plain_classes([plain_print(t) for _, t in rows], 2)
    docs = spooled(stage["simhash_near_dedup"](spark, docs, PATH))
    assert {r.doc_id for r in docs.collect()} == {i for k, (i, _) in enumerate(rows) if classes[k] == k}

    before = sorted((r.doc_id, r.text) for r in docs.collect())
    docs = spooled(stage["substring_dedup"](spark, docs, PATH))
    after = dict((r.doc_id, r.text) for r in docs.collect())
    assert ["".join((after[i] or "").split()) for i, _ in before] == list(without_repeats([t for _, t in before]))

    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    docs = spooled(stage["decontamination"](spark, docs, PATH))
    cut = dict((r.doc_id, r.text) for r in docs.collect())
    hit = {n for n, _, places, _ in brute(after.items(), items) if places}
    assert hit and all(cut[i] == t for i, t in after.items() if i not in hit)
    assert all(words(cut[i]) == without_leaks(after[i], items) for i in hit)

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    want = []
    for i, t in cut.items():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, stage["byte_bpe"](spark, docs, PATH).collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, PATH).collect())) == sorted(want)
