"""Token-id files: exact round trip, places and Elias-Fano code against plain counting."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from callscope.llm import registry, token_ids
from callscope.llm.common import shared_path
from callscope.llm.token_ids import EliasFano
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**63 - 1)), max_size=400))
def test_elias_fano(values):
    values = sorted(values)
    code = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert code.select_range(0, len(values)).tolist() == values
    for a, b in ((0, 1), (3, 70), (64, 65), (63, 129), (100, 100), (len(values) - 1, len(values))):
        a, b = min(max(a, 0), len(values)), min(max(b, 0), len(values))
        assert code.select_range(a, b).tolist() == values[a:b]
    for v in values[::40]:
        assert code.first_not_below(v) == values.index(v)
    assert [code.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20_000))
    assert len(EliasFano.encode(ends).to_bytes()) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 2


def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_edge_rows(spark, monkeypatch):
    long = "word " * 60_000 + "é" * 30_000
    rows = [(5, "a b", 1), (None, "null id", 2), (3, None, 3), (3, "", 4), (7, "<|endoftext|> x", 5), (7, "<|endoftext|> x", 5), (-9, long, 6), (None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnRenamed("ids", "part")
    path = shared_path(spark, "t-ids")
    token_ids.write_token_ids(docs, path, JSON)
    got = token_ids.read_token_ids(spark, path).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (i is not None, i or 0, len(tokenizer().encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -9, 3, 3, 5, 7, 7]
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert (r.start, r.n_tokens, ids[-1]) == (at, len(ids), 0)
        at += len(ids)
    for r in got:
        if r.doc_id == -9:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist()[:-1] == tokenizer().encode(long, add_special_tokens=False).ids


def test_documents_by_id(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = shared_path(spark, "t-ids")
    token_ids.write_token_ids(docs.union(docs.where("doc_id = 7")), path, JSON)
    some = [0, 7, 55, 56, 10**9, -3]
    whole = sorted(map(tuple, token_ids.read_token_ids(spark, path).where(f"doc_id in ({','.join(map(str, some))})").collect()))
    got = token_ids.read_documents(spark, path, some)
    assert sorted(map(tuple, got.collect())) == whole and len(whole) == 5
    assert token_ids.read_documents(spark, path, []).count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = token_ids.read_documents(spark, path, some)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(doc_base" in plan and "GreaterThanOrEqual(last_id" in plan


def test_empty_table(spark):
    path = shared_path(spark, "t-ids")
    token_ids.write_token_ids(spark.createDataFrame([], "doc_id long, text string"), path, JSON)
    assert token_ids.read_token_ids(spark, path).count() == 0


@pytest.mark.parametrize("segment", [1, 900, 10**6])
def test_query_against_counting(spark, monkeypatch, segment):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t, at, want = tokenizer(), 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    if segment == 10**6:
        got = registry.op1_token_ids(spark, "/root/testdata/sf0.001").collect()
        assert sorted(tuple(r) for r in got) == want


def test_segments_are_cut(monkeypatch):
    from pyspark import TaskContext

    monkeypatch.setattr(token_ids, "SEGMENT_IDS", 3)
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 4})()))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 9]), pa.array(["a b c d e", "", "f"])], ["id", "text"])
    rows = [r for b in token_ids._segments(JSON, b"\0\0\0\0")([batch]) for r in b.to_pylist()]
    assert [(r["part"], r["seq"], r["n_docs"], r["n_ids"]) for r in rows] == [(4, 0, 1, 6), (4, 1, 2, 3)]
