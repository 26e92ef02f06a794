"""A batch without repeated ids is not shuffled; of repeated ones the earliest row stays."""

import contextlib
import datetime as dt
import io

from pyspark.sql import functions as F

from callscope.sources.store import dedupe_batch


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_batch_without_repeats_is_not_joined(make_calls):
    df = make_calls([dict(id="a"), dict(id="b"), dict(id="", latency_ms=2), dict(id="", latency_ms=1)]).withColumn("id", F.nullif("id", F.lit("")))
    out = dedupe_batch(df)
    assert "Join" not in _plan(out)
    assert sorted((r.id or "", r.latency_ms) for r in out.collect()) == [("", 1), ("a", 120), ("b", 120)]


def test_batch_with_repeats(make_calls):
    t = dt.datetime(2024, 1, 1)
    df = make_calls([dict(id="a"), dict(id="b", call_ts=t, latency_ms=9), dict(id="b", call_ts=t, latency_ms=3), dict(id="b", latency_ms=1), dict(id=""), dict(id="")]).withColumn("id", F.nullif("id", F.lit("")))
    assert sorted((r.id or "", r.latency_ms) for r in dedupe_batch(df).collect()) == [("", 120), ("a", 120), ("b", 3)]
