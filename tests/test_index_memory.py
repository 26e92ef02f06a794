"""Postings are cut from some tokens at a time: the memory depends neither on the records of a batch nor on their number."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from callscope.operators import search as se
from callscope.operators.search_index import SearchIndex
from callscope.session import scratch_dir


def _batch(texts):
    lists = pa.array([t.split() for t in texts], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), lists, lists], names=["id", "t0", "t1"])


def test_memory_of_a_large_batch():
    batch = _batch(["a b c d e a b c d e"] * 100_000)  # two million tokens in two columns
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in se._posting_batches(2)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 500_000
    assert most < 60 << 20  # it was 146 MB


def test_cuts_lose_nothing(monkeypatch):
    texts = ["", "b a b", "", "c " * 70, "a", "", "d e f g h a", "a"]

    def rows():
        return [r for b in se._posting_batches(2)(iter([_batch(texts), _batch([]), _batch([""])])) for r in b.to_pylist()]

    whole = rows()
    monkeypatch.setattr(se, "TOKENS_CUT", 5)
    parts = rows()

    def without_lead(found):
        return sorted((r["id"], r["token"], r["tf"], r["positions"], r["doc_len"]) for r in found)

    assert without_lead(parts) == without_lead(whole)
    # one row of a record leads, whichever it is
    assert sorted(r["id"] for r in parts if r["lead"]) == sorted({r["id"] for r in whole}) == sorted(r["id"] for r in whole if r["lead"])
    assert [r["doc_len"] for r in whole if r["lead"]] == [6, 140, 2, 12, 2]
    assert (1, "b", 4, [0, 2, 1 << 32, (1 << 32) + 2], 6) in without_lead(parts)


def test_index_restores_settings(spark):
    keys = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = [spark.conf.get(k) for k in keys]
    index = SearchIndex(spark, scratch_dir(spark, "t-index-memory"), "id", ["t"], 4)
    index.replace(spark.range(300).select("id", F.concat_ws(" ", F.lit("x"), F.col("id").cast("string")).alias("t")))
    assert [spark.conf.get(k) for k in keys] == before
    assert index.postings().count() == 600 and index.stats()[:2] == (300, 600.0)
