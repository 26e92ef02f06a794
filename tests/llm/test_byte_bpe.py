"""Tree-reduced byte-level BPE against the public library, and exact round trips."""

import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken
from callscope.llm import byte_bpe, registry
from callscope.llm.byte_bpe import ByteBpe, join_pieces, split_tree
from callscope.llm.pieces import split
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def table():
    with open(RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(table):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t\r'stadé½日😀.!-1", max_size=60), st.text(alphabet=" \n\t\r'stadé½日😀.!-1", max_size=60))
def test_pieces_join_anywhere(a, b):
    if a and b:
        assert join_pieces(split(a), split(b)) == split(a + b)


@pytest.mark.parametrize("alphabet", ["ab", "aaaa", " \n\ta", "x1 .'st", "é²½a   ", "xyz!?- \n", "😀é ", "Abcdefgh tion"])
def test_trees_of_every_leaf_size(table, library, monkeypatch, alphabet):
    rand, bpe = random.Random(alphabet), ByteBpe(table)
    for n in [*range(25), 200, 3000]:
        text = "".join(rand.choice(alphabet) for _ in range(n))
        monkeypatch.setattr(byte_bpe, "TEXT_LEAF", rand.choice([1, 2, 3, 7, 50]))
        monkeypatch.setattr(byte_bpe, "PIECE_LEAF", rand.choice([1, 2, 3, 8, 24]))
        monkeypatch.setattr(byte_bpe, "IDS_LEAF", rand.choice([1, 5, 100]))
        bpe.memo.clear()
        assert split_tree(text) == split(text)
        ids = bpe.encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["-" * 1_000_003, "=-" * 500_001, "a" * 1_000_001, " " * 1_000_000 + "x", "ab" * 300_000 + "c" * 300_001, "é" * 300_001])
def test_long_pieces_take_seconds(table, library, text):
    began = time.process_time()
    ids = ByteBpe(table).encode(text).tolist()
    assert time.process_time() - began < 10
    # piece by piece: the library's own splitting does not survive a million spaces
    assert ids == [i for piece in split(text) for i in library._encode_single_piece(piece.encode())]


def test_merges_agree(table, library):
    rand, bpe = random.Random(5), ByteBpe(table)
    for n in range(2, 400, 3):
        data = "".join(rand.choice("aabc-") for _ in range(n)).encode()
        assert bpe.merge(data) == (bpe._merge_long(data) if data not in table else [table[data]]) == library._encode_single_piece(data)


def test_edge_rows(spark, library):
    texts = [None, "", " ", "\n" * 5000, "a" * 20_000, "ünïcode <|endoftext|>", "ünïcode <|endoftext|>", "word " * 50_000]
    docs = spark.createDataFrame([(i if i % 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n long").withColumnRenamed("n", "ids")
    got = byte_bpe.encode(docs, RANKS)
    got = got.withColumn("back", byte_bpe.decode_ids(RANKS)("ids")).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.back)) for r in got) == sorted(
        (str(i if i % 3 else None), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts))
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0
    assert spark.range(1).select(byte_bpe.decode_ids(RANKS)(F.lit(None).cast("array<int>")).alias("b")).first().b == b""


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = []
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in registry.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()) == sorted(want)
