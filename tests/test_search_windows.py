import datetime as dt
import math

import pandas as pd
import pytest

from callscope.functions.text import py_tokens
from callscope.operators import search as se
from callscope.operators.workflows import running_cost
from callscope.session import scratch_dir
from callscope.sources.store import append_calls, load_calls, prune_older_than

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "Quick thinking: the fox, the dog and the café"),
    (3, "A lazy afternoon; no fox here. Cafe au lait."),
    (4, "the the the fox fox"),
    (5, ""),
]


def brute_bm25(docs, query):
    toks = {i: py_tokens(t) for i, t in docs}
    phrases = [py_tokens(p) for p in query.split() if py_tokens(p)]
    if not phrases:
        return {}
    n = len(docs)
    avg = sum(len(t) for t in toks.values()) / n

    def occ(t, p):
        return sum(1 for s in range(len(t) - len(p) + 1) if t[s:s + len(p)] == p)
    dfreq = [sum(1 for t in toks.values() if occ(t, p) > 0) for p in phrases]
    out = {}
    for i, t in toks.items():
        fs = [occ(t, p) for p in phrases]
        if all(f > 0 for f in fs):
            score = 0.0
            for f, nd in zip(fs, dfreq):
                idf = math.log((n - nd + 0.5) / (nd + 0.5))
                idf = idf if idf > 0 else 1e-6
                score += idf * (f * 2.2) / (f + 1.2 * (1 - 0.75 + 0.75 * len(t) / avg))
            out[i] = -score
    return out


@pytest.mark.parametrize("query", ["fox", "the fox", "lazy-dog", "cafe", "quick-brown fox", "nothing-here", ""])
def test_bm25_against_brute_force(spark, query):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    idx, lens = se.token_index(df, "doc_id", ["text"]), se.doc_lengths(df, "doc_id", ["text"])
    got = {r.id: r.rank for r in se.bm25_scores(idx, lens, query).collect()}
    want = brute_bm25(DOCS, query)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_persisted_index_search_equals_in_memory(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = scratch_dir(spark, "t-idx")
    ip, lp = se.write_index(df, path, "doc_id", ["text"], buckets=8)
    idx, lens = se.read_index(spark, ip, lp)
    stats = se.read_stats(spark, ip)
    a = [(r.doc_id, r.rank) for r in se.search(df, idx, lens, "of-the and", 10, "doc_id", stats).collect()]
    mi, ml = se.token_index(df, "doc_id", ["text"]), se.doc_lengths(df, "doc_id", ["text"])
    b = [(r.doc_id, r.rank) for r in se.search(df, mi, ml, "of-the and", 10, "doc_id").collect()]
    assert [x[0] for x in a] == [x[0] for x in b] and len(a) > 0
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b])


def test_running_cost_matches_sequential(spark, make_calls):
    rows = [dict(id=f"c{i:03d}", call_ts=dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i % 37, seconds=i),
                 cost_usd=None if i % 7 == 0 else i / 1000.0) for i in range(200)]
    got = running_cost(make_calls(rows), partitions=5).toPandas().sort_values(["call_ts", "id"])
    pdf = pd.DataFrame([(r["id"], r["call_ts"], r["cost_usd"] or 0.0) for r in rows],
                       columns=["id", "call_ts", "cost"]).sort_values(["call_ts", "id"])
    assert list(got["id"]) == list(pdf["id"])
    assert list(got["cum_cost"]) == pytest.approx(list(pdf["cost"].cumsum()))


def test_prune_golden(spark, make_calls):
    path = scratch_dir(spark, "t-prune")
    now = dt.datetime(2024, 6, 1, 12)
    append_calls(make_calls([dict(id="old", call_ts=dt.datetime(2020, 1, 1)), dict(id="new", call_ts=now)]), path)
    assert prune_older_than(spark, path, 1, now) == 1
    assert [r.id for r in load_calls(spark, path).collect()] == ["new"]
    assert prune_older_than(spark, path, 0, now) == 0


def test_token_bucket_matches_spark(spark):
    from pyspark.sql import functions as F
    terms = ["the", "fox", "café", "naïve", "x", "", "4o", "überprüfung"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    got = {r.t: r.b for r in df.select("t", F.pmod(F.xxhash64("t"), F.lit(16)).alias("b")).collect()}
    assert got == {t: se.token_bucket(t, 16) for t in terms}


def test_decomposed_accents_do_not_split_words(spark):
    df = spark.createDataFrame([(1, "Résumé of Ångström"), (2, "résumé"), (3, "")], "doc_id long, text string")
    toks = {}
    for r in se.token_index(df, "doc_id", ["text"]).orderBy("pos").collect():
        toks.setdefault(r.id, []).append(r.token)
    assert toks == {1: ["resume", "of", "angstrom"], 2: ["resume"]}
    assert se.parse_query("résumé") == [["resume"]]


def test_written_index_needs_no_length_join(spark):
    path = scratch_dir(spark, "t-ix2")
    df = spark.createDataFrame([(i, f"alpha beta {'gamma ' * (i % 5)}") for i in range(40)] + [(99, "")], "doc_id long, text string")
    ip, lp = se.write_index(df, path, "doc_id", ["text"], buckets=4)
    idx, lens = se.read_index(spark, ip, lp)
    assert lens.where("id = 99").first().doc_len == 0 and se.read_stats(spark, ip)[0] == 41
    plan = se.bm25_scores(idx, lens, "gamma alpha", se.read_stats(spark, ip))._jdf.queryExecution().executedPlan().toString()
    assert "lengths" not in plan
    assert se.index_backfill(df, lens, "doc_id", ["text"]).count() == 0
    hits = se.search(df, idx, lens, "gamma-gamma", 3, "doc_id", se.read_stats(spark, ip))
    assert all("gamma gamma" in r.snippet for r in se.with_snippet(hits, "gamma-gamma", "text").collect())
