"""Registered streaming queries.

Each query lands data derived from the test tables on shared storage,
runs the streaming job to completion with an ``availableNow`` trigger
(several micro-batches: at most a few files per trigger) and returns what
the sink holds. Stream results equal the batch operators (see tests).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.predicates import CallFilter
from callscope.plans.catalog import AS_OF, calls, register
from callscope.schema import CALL_COLUMNS

_NO_BODY = ", ".join(c for c in CALL_COLUMNS if c not in ("request_body", "response_body"))
from callscope.plans.q_enrich import _ex
from callscope.plans.q_metrics import _hist_sql
from callscope.session import scratch_dir
from callscope.sources.store import append_calls, load_calls
from callscope.streaming import live as lv

FILES_PER_TRIGGER = 5
#: Row groups of the files that streams read: few bytes each, so that the few files of a micro-batch are read by all tasks.
FEED = {"parquet.block.size": 4 << 20}


def _store(spark, sf):
    path = scratch_dir(spark, "live-store")
    append_calls(calls(spark, sf), path)
    return path


def _stream(spark, sf):
    return lv.calls_stream(spark, _store(spark, sf), FILES_PER_TRIGGER)


def exchange_log(spark, sf):
    """The exchanges as eight files of a log."""
    src = scratch_dir(spark, "exchange-log")
    _ex(spark, sf).repartition(8).write.options(**FEED).mode("overwrite").parquet(src)
    return src


def _dirs(spark, name):
    return scratch_dir(spark, f"{name}-out"), scratch_dir(spark, f"{name}-ckpt")


@register("watch", f"""SELECT {_NO_BODY}, CAST(call_ts AS DATE) AS call_date FROM calls
  WHERE (error IS NOT NULL OR status_code >= 400 OR status_code = 0) AND contains(lower(model), 'gpt')""", raw=True)
def q_watch(spark, sf):
    """Filtered live tail (errors of gpt models) over newly arriving calls."""
    out, ck = _dirs(spark, "watch")
    q = lv.run_watch(_stream(spark, sf), out, ck, CallFilter(errors_only=True, model="gpt"), available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out)


@register("change_feed")
def q_change_feed(spark, sf):
    """Every arriving call as a JSON event line."""
    out, ck = _dirs(spark, "feed")
    lv.change_feed(_stream(spark, sf), out, ck, available_now=True).awaitTermination()
    return spark.read.text(out)


@register("stream_metrics", """SELECT model, provider, CASE WHEN status_code = 0 THEN 'err'
    WHEN status_code BETWEEN 200 AND 299 THEN '2xx' WHEN status_code BETWEEN 400 AND 499 THEN '4xx'
    WHEN status_code BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS status_class, count(*) AS n,
  CAST(sum(input_tokens) FILTER (WHERE input_tokens > 0) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) FILTER (WHERE output_tokens > 0) AS BIGINT) AS output_tokens,
  round(sum(cost_usd) FILTER (WHERE cost_usd > 0), 9) AS cost_usd FROM calls GROUP BY ALL""")
def q_stream_metrics(spark, sf):
    """Incrementally maintained call/token/cost counters."""
    out, ck = _dirs(spark, "metrics")
    lv.stream_metrics(_stream(spark, sf), out, ck, available_now=True).awaitTermination()
    return lv.read_snapshot(spark, out)["counts"]


@register("budget_monitor")
def q_budget_monitor(spark, sf):
    """I4: monthly spend against a 1 USD limit; throttled alert log."""
    out, ck = _dirs(spark, "budget")
    lv.budget_monitor(_stream(spark, sf), 1.0, "month", out, ck, as_of=AS_OF,
                      available_now=True).awaitTermination()
    return spark.read.parquet(out)


@register("stream_enrich")
def q_stream_enrich(spark, sf):
    """Raw exchanges enriched continuously into the calls store."""
    src = exchange_log(spark, sf)
    store, ck = _dirs(spark, "ingest")
    q = lv.run_ingest(lv.exchanges_stream(spark, src, 2), store, ck, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(store)


@register("fanout_exports")
def q_fanout_exports(spark, sf):
    """Each ingested micro-batch appended to the store and exported (JSON lines + OTLP)."""
    src = exchange_log(spark, sf)
    store, ck = _dirs(spark, "fanout")
    jl, ot = scratch_dir(spark, "fan-jsonl"), scratch_dir(spark, "fan-otlp")
    q = lv.run_ingest(lv.exchanges_stream(spark, src, 2), store, ck, exports={"jsonl": jl, "otlp": ot},
                      available_now=True)
    q.awaitTermination()
    return spark.read.text(jl).withColumn("format", F.lit("jsonl")).unionByName(
        spark.read.text(ot).withColumn("format", F.lit("otlp")))


@register("stream_dedup", f"SELECT {_NO_BODY}, CAST(call_ts AS DATE) AS call_date FROM calls", raw=True)
def q_stream_dedup(spark, sf):
    """A feed that delivers every call twice, in no order of time; each id is stored once."""
    path = scratch_dir(spark, "dup-feed")
    c = calls(spark, sf).withColumn("call_date", F.to_date("call_ts"))
    # files that each hold calls of all days, so that most arrive later than newer ones
    c.repartition(6, F.xxhash64("id")).write.options(**FEED).mode("append").parquet(path)
    c.repartition(6, F.xxhash64(F.lit(1), "id")).write.options(**FEED).mode("append").parquet(path)
    out, ck = _dirs(spark, "dedup")
    lv.stream_dedup(lv.calls_stream(spark, path, FILES_PER_TRIGGER), out, ck, available_now=True).awaitTermination()
    return load_calls(spark, out, with_partition=True).drop("request_body", "response_body")


@register("watch_budget", """SELECT count(*) AS calls, round(coalesce(sum(cost_usd), 0.0), 9) AS spent_usd,
  5.0::DOUBLE AS limit_usd, CAST(floor(coalesce(sum(cost_usd), 0.0) / 5.0 * 100.0) AS BIGINT) AS pct,
  floor(coalesce(sum(cost_usd), 0.0) / 5.0 * 100.0) >= 80 AS warn
  FROM calls WHERE call_ts >= TIMESTAMP '2024-01-29 00:00:00'""")
def q_watch_budget(spark, sf):
    """I8: running spend of the current week with the budget line."""
    out, ck = _dirs(spark, "wbudget")
    agg = lv.watch_budget(_stream(spark, sf), 5.0, "week", "2024-01-30T10:00:00")

    def snap(batch, epoch):
        batch.write.mode("overwrite").parquet(out)
    q = agg.writeStream.outputMode("complete").foreachBatch(snap).option("checkpointLocation", ck) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_metric_families", f"""SELECT 'latency' AS family, model AS a, le AS b, n, sum, count FROM ({_hist_sql("latency_ms")})
  UNION ALL SELECT 'ttft', model, le, n, sum, count FROM ({_hist_sql("ttft_ms")})
  UNION ALL SELECT 'agents', agent_name, NULL, count(*), NULL, NULL FROM calls WHERE agent_name IS NOT NULL GROUP BY agent_name
  UNION ALL SELECT 'calls', model, provider, count(*), NULL, NULL FROM calls GROUP BY model, provider
  UNION ALL SELECT 'tokens', model, 'input', CAST(sum(input_tokens) AS BIGINT), NULL, NULL FROM calls WHERE input_tokens > 0 GROUP BY model
  UNION ALL SELECT 'tokens', model, 'output', CAST(sum(output_tokens) AS BIGINT), NULL, NULL FROM calls WHERE output_tokens > 0 GROUP BY model
  UNION ALL SELECT 'cost', model, NULL, CAST(round(sum(cost_usd) * 1e4) AS BIGINT), NULL, NULL FROM calls WHERE cost_usd > 0 GROUP BY model""")
def q_stream_metric_families(spark, sf):
    """All six metric families kept incrementally over arriving calls."""
    out, ck = _dirs(spark, "families")
    lv.stream_metric_families(_stream(spark, sf), out, ck, available_now=True).awaitTermination()
    read = lv.read_snapshot(spark, out).__getitem__
    none = F.lit(None).cast("long")
    hist = [read(k).select(F.lit(k).alias("family"), F.col("model").alias("a"), F.col("le").alias("b"), "n", "sum", "count") for k in ("latency", "ttft")]
    rest = [read("agents").select(F.lit("agents"), "agent_name", F.lit(None).cast("string"), "n", none, none),
            read("calls").groupBy("model", "provider").agg(F.sum("n").alias("n")).select(F.lit("calls"), "model", "provider", "n", none, none),
            read("tokens").groupBy("model", "type").agg(F.sum("n").alias("n")).select(F.lit("tokens"), "model", "type", "n", none, none),
            read("cost").groupBy("model").agg(F.round(F.sum("usd") * 1e4).cast("long").alias("n")).select(F.lit("cost"), "model", F.lit(None).cast("string"), "n", none, none)]
    df = hist[0].union(hist[1])
    for r in rest:
        df = df.union(r)
    return df


@register("watch_budget_periods", """SELECT CAST(date_trunc('week', call_ts) AS TIMESTAMP) AS period_start, count(*) AS calls, round(coalesce(sum(cost_usd), 0.0), 9) AS spent_usd,
  2.0::DOUBLE AS limit_usd, CAST(floor(coalesce(sum(cost_usd), 0.0) / 2.0 * 100.0) AS BIGINT) AS pct,
  floor(coalesce(sum(cost_usd), 0.0) / 2.0 * 100.0) >= 80 AS warn FROM calls GROUP BY 1""")
def q_watch_budget_periods(spark, sf):
    """I8: a budget line for every week that the arriving calls reach."""
    out, ck = _dirs(spark, "periods")
    lines = lv.watch_budget_periods(_stream(spark, sf), 2.0, "week")

    def snap(batch, epoch):
        batch.write.mode("overwrite").parquet(out)
    lines.writeStream.outputMode("complete").foreachBatch(snap).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@register("running_spend", """SELECT id, call_ts, model, round(coalesce(cost_usd, 0.0), 9) AS cost_usd,
  round(sum(coalesce(cost_usd, 0.0)) OVER (ORDER BY call_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS cum_cost FROM calls""")
def q_running_spend(spark, sf):
    """I8: every tailed call with the cost so far; calls arrive in four files, in order of time."""
    feed = scratch_dir(spark, "spend-feed")
    c = calls(spark, sf).withColumn("call_date", F.to_date("call_ts"))
    days = [None, "2024-01-08", "2024-01-15", "2024-01-22", None]
    for a, b in zip(days, days[1:], strict=False):
        part = c if a is None else c.where(F.col("call_date") >= F.lit(a).cast("date"))
        part = part if b is None else part.where(F.col("call_date") < F.lit(b).cast("date"))
        # one file, but not read and priced by one task
        part.repartition(1).write.options(**FEED).mode("append").parquet(feed)
    out, ck = _dirs(spark, "spend")
    lv.running_spend(lv.calls_stream(spark, feed, 1), out, ck, available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("epoch")


#: Minutes after AS_OF at which the clock is read; the alerts of the first, the fourth and the seventh are ten minutes apart or more.
TICKS = (0, 4, 8, 12, 16, 20, 24)


@register("budget_clock", f"""SELECT 'month' AS period, CAST(date_trunc('month', t) AS TIMESTAMP) AS period_start, 1.0::DOUBLE AS limit_usd, t AS alerted_at,
  (SELECT round(sum(cost_usd), 9) FROM calls WHERE call_ts >= date_trunc('month', t) AND call_ts <= t) AS spent_usd
  FROM (SELECT unnest([TIMESTAMP '{AS_OF}' + m * INTERVAL 1 MINUTE FOR m IN [0, 12, 24]]) AS t)""")
def q_budget_clock(spark, sf):
    """I4: the budget of the stored calls checked by the clock; alerts repeat after ten minutes without a new call."""
    store, ticks = _store(spark, sf), scratch_dir(spark, "ticks")
    for m in TICKS:
        spark.range(1).select((F.lit(AS_OF).cast("timestamp") + F.make_interval(mins=F.lit(m))).alias("now")).coalesce(1).write.mode("append").parquet(ticks)
    out, ck = _dirs(spark, "clock")
    clock = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(ticks)
    lv.budget_clock(clock, lambda s, now: lv.store_spend(s, store, "month", now), 1.0, "month", out, ck, available_now=True).awaitTermination()
    return spark.read.parquet(out).drop("epoch")
