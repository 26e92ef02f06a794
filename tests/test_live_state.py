"""Running spend, the clock-driven budget check, atomic snapshots, day histograms, native running cost."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import percentiles as pc
from callscope.operators import workflows as wf
from callscope.session import scratch_dir
from callscope.sources import store as st
from callscope.sources.histograms import DayHistograms
from callscope.streaming import live as lv

DAY = dt.datetime(2024, 5, 1)


def feed(spark, make_calls, path, rows):
    make_calls(rows).withColumn("call_date", F.to_date("call_ts")).coalesce(1).write.mode("append").parquet(path)


def test_running_spend_over_restarts_and_replays(spark, make_calls):
    path, out, ck = (scratch_dir(spark, n) for n in ("t-sp", "t-sp-o", "t-sp-ck"))
    rows = [dict(id=f"c{i:03d}", call_ts=DAY + dt.timedelta(minutes=i), cost_usd=None if i % 5 == 0 else i / 7) for i in range(60)]
    for k in range(3):
        feed(spark, make_calls, path, rows[20 * k : 20 * k + 20])
        if k != 1:  # the second and third file are met in one run
            lv.running_spend(lv.calls_stream(spark, path, 1), out, ck, available_now=True).awaitTermination()
    want = {r.id: r.cum_cost for r in wf.running_cost(make_calls(rows)).collect()}

    def got():
        return {r.id: r.cum_cost for r in spark.read.parquet(f"{out}/rows").collect()}

    assert got() == pytest.approx(want)
    # the last epoch again, as after a crash before its progress was committed
    before = lv.spend_before(spark, out, 2)
    assert before == pytest.approx(sum(r["cost_usd"] or 0 for r in rows[:40]))
    lv.running_spend(lv.calls_stream(spark, path, 1), out, scratch_dir(spark, "t-sp-ck2"), available_now=True).awaitTermination()
    assert got() == pytest.approx(want)


def test_budget_is_checked_by_the_clock(spark, make_calls):
    store, out, ticks = (scratch_dir(spark, n) for n in ("t-bc", "t-bc-o", "t-bc-t"))
    st.append_calls(make_calls([dict(id="a", call_ts=DAY, cost_usd=3.0)]), store)
    spent = lambda s, now: lv.store_spend(s, store, "day", now)

    def tick(minutes, ck):
        for m in minutes:
            now = F.lit((DAY + dt.timedelta(minutes=m)).isoformat()).cast("timestamp")
            spark.range(1).select(now.alias("now")).coalesce(1).write.mode("append").parquet(ticks)
        stream = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(ticks)
        lv.budget_clock(stream, spent, 2.0, "day", out, ck, available_now=True).awaitTermination()
        return sorted(r.t for r in spark.read.parquet(out).select(F.date_format("alerted_at", "dd HH:mm").alias("t")).collect())

    ck = scratch_dir(spark, "t-bc-ck")
    assert tick([1, 5, 10, 11, 12], ck) == ["01 00:01", "01 00:11"]
    assert tick([21, 30], ck) == ["01 00:01", "01 00:11", "01 00:21"]  # no call came
    assert tick([24 * 60 + 1], ck) == ["01 00:01", "01 00:11", "01 00:21"]  # a new day has no spend
    # all ticks again from the start: the log throttles
    assert tick([], scratch_dir(spark, "t-bc-ck2")) == ["01 00:01", "01 00:11", "01 00:21"]


def test_the_clock_stream_alerts(spark, make_calls):
    out = scratch_dir(spark, "t-rate-o")
    query = lv.budget_clock(lv.clock(spark), lambda s, now: 5.0, 2.0, "day", out, scratch_dir(spark, "t-rate-ck"), every="1 second")
    try:
        deadline = dt.datetime.now() + dt.timedelta(seconds=60)
        while dt.datetime.now() < deadline and not (query.recentProgress and len(query.recentProgress) > 3):
            query.awaitTermination(1)
    finally:
        query.stop()
    assert spark.read.parquet(out).count() == 1


def test_a_snapshot_is_read_whole(spark):
    out = scratch_dir(spark, "t-snap")
    one = lambda n: spark.range(n).coalesce(1)
    with pytest.raises(FileNotFoundError):
        lv.read_snapshot(spark, out)
    lv.write_snapshot({"a": one(1), "b": one(1)}, out)
    reader = lv.read_snapshot(spark, out)

    def between(frame):
        """Reads while the next version is half written."""
        seen = {k: v.count() for k, v in lv.read_snapshot(spark, out).items()}
        assert len(set(seen.values())) == 1, seen
        return frame

    real = lv.Versions.commit
    for n in (2, 3):
        lv.write_snapshot({"a": between(one(n)), "b": between(one(n))}, out)
        between(None)

    def crash(self, *a):
        raise RuntimeError("lost")

    lv.Versions.commit = crash
    try:
        with pytest.raises(RuntimeError):
            lv.write_snapshot({"a": one(9), "b": one(9)}, out)
    finally:
        lv.Versions.commit = real
    assert {k: v.count() for k, v in lv.read_snapshot(spark, out).items()} == {"a": 3, "b": 3}
    assert {k: v.count() for k, v in reader.items()} == {"a": 1, "b": 1}


def test_day_histograms_equal_the_calls(spark, make_calls, monkeypatch):
    from callscope.sources import histograms as hs
    monkeypatch.setattr(hs, "FAN", 3)
    rand = random.Random(4)
    path = scratch_dir(spark, "t-hist")
    rows = [dict(id=f"c{i}", call_ts=DAY + dt.timedelta(hours=rand.randrange(24 * 9)), model=rand.choice(["a", "b", None and "c"]) or "c", latency_ms=rand.choice([None, rand.randrange(5000)]),
                 input_tokens=rand.choice([None, rand.randrange(90)]), output_tokens=rand.choice([None, rand.randrange(90)])) for i in range(400)]
    rows = [r | {"latency_ms": r["latency_ms"] or 0} for r in rows]
    st.append_calls(make_calls(rows[:100]), path)
    DayHistograms(spark, path).create(st.load_calls(spark, path, with_partition=True))
    for a, b in ((50, 200), (0, 250), (240, 399), (390, 400)):
        st.append_calls(make_calls(rows[a:b]), path)
    kept = DayHistograms(spark, path)
    assert len(kept.content["segments"]) < 3

    def compare(since, until):
        df = st.load_calls(spark, path, with_partition=True).where(F.col("call_date").between(F.lit(since), F.lit(until)))
        for got, want in ((kept.latency_percentiles(since, until), pc.latency_percentiles(df)), (kept.token_percentiles(since, until), pc.token_percentiles(df)),
                          (kept.latency_percentiles_by_model(since, until), pc.latency_percentiles_by_model(df))):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    compare(dt.date(2024, 5, 2), dt.date(2024, 5, 4))
    compare(dt.date(2024, 5, 1), dt.date(2024, 5, 31))
    compare(dt.date(2025, 1, 1), dt.date(2025, 1, 2))
    st.prune_older_than(spark, path, 4, DAY + dt.timedelta(days=7, hours=11))
    compare(dt.date(2024, 5, 1), dt.date(2024, 5, 31))
    plan = kept.latency_percentiles(dt.date(2024, 5, 6), dt.date(2024, 5, 7))._jdf.queryExecution().executedPlan().toString()
    assert "_histograms" in plan
    # an append that broke off after the data was written is counted by the next
    with monkeypatch.context() as m:
        m.setattr(DayHistograms, "add", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            st.append_calls(make_calls([dict(id="late", call_ts=DAY + dt.timedelta(days=8), latency_ms=77_777)]), path)
    st.append_calls(make_calls([dict(id="next", call_ts=DAY + dt.timedelta(days=8))]), path)
    kept = DayHistograms(spark, path)
    compare(dt.date(2024, 5, 1), dt.date(2024, 5, 31))


@pytest.mark.parametrize("hot", [False, True])
def test_running_cost_stays_in_the_jvm(spark, make_calls, hot):
    rows = [dict(id=f"c{i:04d}", call_ts=DAY if hot and i % 3 else DAY + dt.timedelta(seconds=i * 7 % 501), cost_usd=i / 9) for i in range(700)]
    df = wf.running_cost(make_calls(rows), partitions=6)
    total, want = 0.0, {}
    for r in sorted(rows, key=lambda r: (r["call_ts"], r["id"])):
        total += r["cost_usd"]
        want[r["id"]] = total
    assert {r.id: r.cum_cost for r in df.collect()} == pytest.approx(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    slices = [r["count"] for r in make_calls(rows).withColumn("s", wf._slice(wf.order_splitters(make_calls(rows), 6))).groupBy("s").count().collect()]
    assert len(slices) == 6 and max(slices) < 3 * 700 / 6
