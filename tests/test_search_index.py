"""Segments of the search index: equal to one index over all records; postings, blocks, versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import search as se
from callscope.operators import search_index as si
from callscope.session import scratch_dir
from callscope.sources.versions import Versions

WORDS = ["the"] * 30 + ["of"] * 12 + ["fox", "Café", "x1", "lazy", "quick"] * 2 + ["rare"]


def records(spark, n, seed=1):
    rand = random.Random(seed)
    rows = [(i, " ".join(rand.choice(WORDS) for _ in range(rand.randrange(0, 60))), rand.choice([None, "", "the fox", "tag-of"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, tags string")


def ranked(df):
    return [(r[0], r["rank"]) for r in df.collect()]


def same(a, b):
    assert [x[0] for x in a] == [x[0] for x in b] and a
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-12)


@pytest.fixture(scope="module")
def grown(spark):
    """An index of eleven batches, some of them merged, some records given twice."""
    df = records(spark, 400).cache()
    index = si.SearchIndex(spark, scratch_dir(spark, "t-seg"), "doc_id", ["text", "tags"], 8)
    added = [index.add(df.where(f"doc_id >= {max(0, k * 30 - 10)} and doc_id < {k * 30 + (30 if k < 10 else 100)}")) for k in range(11)]
    assert added == [30] * 10 + [100]
    return df, index


def test_segments_are_merged_and_read_as_one(spark, grown):
    df, index = grown
    assert len(index.segments()) == 4 and index.stats()[0] == 400
    again = si.SearchIndex(spark, index.root, "doc_id", ["text", "tags"])
    assert again.buckets == 8 and again.add(df) == 0 and again.segments() == index.segments()
    lens = {r.id: r.doc_len for r in se.doc_lengths(df, "doc_id", ["text", "tags"]).collect()}
    assert {r.id: r.doc_len for r in index.lengths().collect()} == lens


@pytest.mark.parametrize("query", ["the", "fox", "rare lazy", "the-fox of", "tag-of", "the-the-the", "cafe", "absent", ""])
def test_search_over_segments_equals_a_scan(spark, grown, query):
    df, index = grown
    idx, lens = se.token_index(df, "doc_id", ["text", "tags"]), se.doc_lengths(df, "doc_id", ["text", "tags"])
    want = ranked(se.bm25_scores(idx, lens, query).orderBy("rank", "id"))
    got = ranked(index.scores(query).orderBy("rank", "id"))
    if want:
        same(got, want)
        same(ranked(index.top(query, 17)), want[:17])
        same(ranked(index.search(df, query, 5).select("doc_id", "rank")), want[:5])
    else:
        assert not got and not ranked(index.top(query, 17))


def test_postings_hold_every_occurrence(spark):
    df = records(spark, 60, 3)
    want = {}
    for r in se.token_index(df, "doc_id", ["text", "tags"]).collect():
        want.setdefault((r.token, r.id), []).append((0 if r.col == "text" else 1 << 32) + r.pos)
    rows = se.postings(df, "doc_id", ["text", "tags"]).collect()
    assert {(r.token, r.id): list(r.positions) for r in rows} == {k: sorted(v) for k, v in want.items()}
    assert all(r.tf == len(r.positions) for r in rows)
    leads = [r.id for r in rows if r.lead]
    assert sorted(leads) == sorted({i for _, i in want})


def test_each_column_is_tokenised_once(spark):
    plan = se.postings(records(spark, 5), "doc_id", ["text", "tags"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2, plan


def test_top_k_reads_few_postings_of_a_frequent_token(spark):
    rand = random.Random(9)
    rows = [(i, " ".join(["the"] * rand.randrange(1, 9) + ["pad"] * rand.randrange(1, 400))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = si.SearchIndex(spark, scratch_dir(spark, "t-blocks"), "doc_id", ["text"], 4)
    index.add(df)
    whole = ranked(index.scores("the").orderBy("rank", "id").limit(10))
    idf, blocks, postings = index._plan("the")
    assert sum(b[2] for b in blocks) == 4000
    same(ranked(index.top("the", 10)), whole)
    read = []
    real = si.SearchIndex._ranks
    si.SearchIndex._ranks = lambda self, rows, idf, chosen: read.append(chosen) or real(self, rows, idf, chosen)
    try:
        index.top("the", 10)
    finally:
        si.SearchIndex._ranks = real
    share = sum(n for _, b, n in blocks if b in read[-1]) / 4000
    assert share < 0.1, share
    assert math.isclose(idf, se.IDF_FLOOR)
    plan = index._ranks(postings, idf, [b[1] for b in blocks[:2]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_a_reader_keeps_its_version(spark):
    index = si.SearchIndex(spark, scratch_dir(spark, "t-ver"), "doc_id", ["text"], 2)
    df = records(spark, 40, 5).select("doc_id", "text")
    index.add(df.where("doc_id < 20"))
    reader = si.SearchIndex(spark, index.root, "doc_id", ["text"])
    index.add(df)
    assert reader.lengths().count() == 20 and index.lengths().count() == 40
    other = Versions(spark, index.root)
    with pytest.raises(Exception, match="(?i)exist"):
        other.commit({}, index.number - 1)
    assert other.current()[0] == index.number


def test_index_is_smaller_than_occurrences(spark):
    import os
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = scratch_dir(spark, "t-size-a"), scratch_dir(spark, "t-size-b")
    se.token_index(df, "doc_id", ["text"]).orderBy("token", "id", "pos").coalesce(1).write.mode("overwrite").parquet(a)
    se.write_index(df, b, "doc_id", ["text"], buckets=1)
    size = lambda top: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet"))
    occurrences = se.token_index(df, "doc_id", ["text"]).count()
    index = si.SearchIndex(spark, b, "doc_id", ["text"])
    assert index.postings().count() < occurrences
    assert index.postings().agg(F.sum("tf")).first()[0] == occurrences
