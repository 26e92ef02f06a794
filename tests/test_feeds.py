"""Feeds at scale: a stream's text is built once, the files of a feed are read by all tasks."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from callscope.plans import q_streaming as qs
from callscope.plans.catalog import all_queries
from callscope.sources.exchanges import CHUNK_CHARS, exchanges_view


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def talk(spark, tmp_path):
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", None if (c, t) == (3, 4) else f"é{c} " * (1 + 40 * t)) for c in range(1, 15) for t in range(8)]
    rows += [(c, 3, "assistant", "😀ab\n" * 70) for c in range(20, 34)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_stream_text_is_cut_whole(spark, talk):
    streams = [r for r in exchanges_view(spark, talk).collect() if r.chunks is not None]
    assert len(streams) >= 10
    for r in streams:
        if int(r.exchange_id[:6]) % 4 == 2:
            assert (r.chunks[0].offset_ms, r.chunks[0].data) == (5, "")
        pieces = [c for c in r.chunks if c.data]
        assert [c.offset_ms for c in pieces] == [30 + 7 * i for i in range(len(pieces))]
        assert all(len(c.data) == CHUNK_CHARS for c in pieces[:-1]) and 0 < len(pieces[-1].data) <= CHUNK_CHARS
        assert "".join(c.data for c in pieces).endswith("\n\n")


def test_stream_text_is_built_once(spark, talk):
    df = exchanges_view(spark, talk).select("chunks", "latency_ms")
    assert _plan(df).count("keep-alive") == 1  # it was built anew for each piece of 64 characters


def _events(spark, path):
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(F.col("event_id") * 5).cast("int"))
    spark.range(0, 8000, 1, 4).withColumnRenamed("id", "event_id").select(
        "event_id", ts.alias("ts"), (F.col("event_id") % 50).alias("user_id"), F.lit("click").alias("event_type"),
        (F.col("event_id") % 97).cast("double").alias("value"), F.lit('{"k":3}').alias("props")).write.parquet(f"{path}/events.parquet")


def test_spend_feed_is_four_files_of_small_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    _events(spark, str(tmp_path))
    monkeypatch.setattr(qs, "FEED", {"parquet.block.size": 1 << 10, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10})
    feeds, made = [], qs.scratch_dir
    monkeypatch.setattr(qs, "scratch_dir", lambda s, name: feeds.append((name, made(s, name))) or feeds[-1][1])
    out = all_queries()["running_spend"](spark, str(tmp_path))
    assert out.count() == 8000 and out.select("id").distinct().count() == 8000
    last = out.orderBy(F.col("call_ts").desc(), F.col("id").desc()).first()
    assert last.cum_cost == pytest.approx(out.agg(F.sum("cost_usd")).first()[0])
    feed = dict(feeds)["spend-feed"]
    files = [f for f in spark.read.parquet(feed).inputFiles()]
    assert len(files) == 4
    assert all(pq.ParquetFile(f.removeprefix("file://")).num_row_groups > 1 for f in files)
