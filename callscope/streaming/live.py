"""Live side with Structured Streaming.

Sources are file streams over shared storage (new parquet files of the
calls store or of the raw exchange log); every query keeps its progress in
a checkpoint folder under ``spark.checkpoint.dir`` so a restarted or
re-scheduled driver resumes exactly where it stopped, and arrivals are
never skipped (the source is arrival-ordered, not timestamp-cursored).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from callscope.functions.predicates import CallFilter, parse_since, status_class, ts_literal, utc_now, with_time_window
from callscope.operators.enrich import EnrichOptions, enrich_calls
from callscope.operators import metrics as mt
from callscope.operators.metrics import DEFAULT_BOUNDS_MS, period_start
from callscope.operators.workflows import running_cost
from callscope.schema import CALLS, EXCHANGES
from callscope.sources import exports as ex
from callscope.sources.store import _exists, append_calls, load_calls
from callscope.sources.versions import Versions

STORE_SCHEMA = T.StructType(CALLS.fields + [T.StructField("call_date", T.DateType())])
# Budget alert throttle and tail poll settings.
ALERT_EVERY = dt.timedelta(minutes=10)
DEFAULT_POLL = "250 milliseconds"
MAX_FILES_PER_TRIGGER = 100


def calls_stream(spark: SparkSession, store_path: str, max_files: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """New calls as they land in the store (file source, bounded files per micro-batch)."""
    return (spark.readStream.schema(STORE_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(store_path))


def exchanges_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.schema(EXCHANGES).option("maxFilesPerTrigger", max_files).parquet(path)


def _start(writer, checkpoint: str, available_now: bool, poll: str):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=poll)
    return w.start()


def watch(stream: DataFrame, f: CallFilter | None = None) -> DataFrame:
    """Filtered tail of new calls (bodies dropped, as the live listing shows them)."""
    s = stream if f is None else f.apply(stream)
    return s.drop("request_body", "response_body")


def run_watch(stream: DataFrame, out: str, checkpoint: str, f: CallFilter | None = None,
              available_now: bool = False, poll: str = DEFAULT_POLL) -> StreamingQuery:
    """I1 sink: append the filtered tail to parquet files."""
    return _start(watch(stream, f).writeStream.format("parquet").option("path", out).outputMode("append"),
                  checkpoint, available_now, poll)


def change_feed(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False,
                poll: str = DEFAULT_POLL) -> StreamingQuery:
    """Every new call as one JSON event line (no reader ever skips records)."""
    lines = ex.jsonl(stream).select("line")
    return _start(lines.writeStream.format("text").option("path", out).outputMode("append"),
                  checkpoint, available_now, poll)


def write_snapshot(tables: dict[str, DataFrame], out: str) -> None:
    """Write a set of tables as the next version of the snapshot at ``out``.

    Every version has a folder of its own, and a version file (``sources/versions.py``) that is
    committed last names it; so a reader gets all tables of one version, at any moment and after
    a crash between the writes. Folders that no readable version names are removed.
    """
    spark = next(iter(tables.values())).sparkSession
    versions, name = Versions(spark, out), f"snapshot-{uuid.uuid4().hex[:12]}"
    for table, rows in tables.items():
        rows.write.parquet(f"{out}/{name}/{table}")
    number, _ = versions.current()
    before = versions.kept()
    versions.commit({"folder": name, "tables": sorted(tables)}, number)
    for gone in {c["folder"] for c in before} - {c["folder"] for c in versions.kept()}:
        versions.delete(gone)


def read_snapshot(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """All tables of the newest committed snapshot at ``out``."""
    _, content = Versions(spark, out).current()
    if not content:
        raise FileNotFoundError(f"no snapshot at {out}")
    return {t: spark.read.parquet(f"{out}/{content['folder']}/{t}") for t in content["tables"]}


def stream_metrics(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False,
                   poll: str = DEFAULT_POLL) -> StreamingQuery:
    """Call counters maintained incrementally (state keyed by model, provider, status class).

    Each micro-batch commits a new snapshot (``read_snapshot``); the state is
    bounded by the number of distinct label combinations.
    """
    counts = stream.groupBy("model", "provider", status_class().alias("status_class")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("input_tokens") > 0, F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(F.col("output_tokens") > 0, F.col("output_tokens"))).alias("output_tokens"),
        F.sum(F.when(F.col("cost_usd") > 0, F.col("cost_usd"))).alias("cost_usd"))

    def snapshot(batch: DataFrame, epoch: int) -> None:
        write_snapshot({"counts": batch}, out)

    return _start(counts.writeStream.outputMode("complete").foreachBatch(snapshot), checkpoint,
                  available_now, poll)


def stream_metric_families(stream: DataFrame, out: str, checkpoint: str, bounds=DEFAULT_BOUNDS_MS,
                           available_now: bool = False, poll: str = DEFAULT_POLL) -> StreamingQuery:
    """All six metric families kept incrementally (calls, tokens, cost, latency, time to first token, agents).

    One state row per (model, provider, status class, agent) holds every
    measure; each micro-batch commits one snapshot of all families
    (``read_snapshot``). The state is bounded by the label combinations.
    """
    bounds = sorted(int(b) for b in bounds)
    measures = mt.measures(stream, bounds)

    def snapshot(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        write_snapshot(mt.families(batch, bounds), out)
        batch.unpersist()

    return _start(measures.writeStream.outputMode("complete").foreachBatch(snapshot), checkpoint, available_now, poll)


def watch_budget_periods(stream: DataFrame, limit_usd: float, period: str) -> DataFrame:
    """I8: calls and spend of every budget period, by the calls' own time, with the budget line.

    The period follows the events, so a stream that runs past midnight, Monday
    or the first of a month goes on in a new row.
    """
    unit = {"day": "day", "week": "week"}.get(period, "month")
    spent = stream.groupBy(F.date_trunc(unit, "call_ts").alias("period_start")).agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"))
    limit = F.lit(float(limit_usd))
    pct = F.when(limit > 0, F.floor(F.col("spent_usd") / limit * 100.0)).otherwise(F.lit(0)).cast("long")
    return spent.select("period_start", "calls", "spent_usd", limit.alias("limit_usd"), pct.alias("pct"), (pct >= 80).alias("warn"))


def stream_dedup(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False,
                 poll: str = DEFAULT_POLL) -> StreamingQuery:
    """Every id once, however late or out of order its copies arrive.

    Each micro-batch is appended through the store's anti-join on the id
    (``append_calls``), so there is no state to expire, no late call is
    dropped, and a replayed batch adds nothing.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        append_calls(batch, out)

    return _start(stream.writeStream.foreachBatch(sink), checkpoint, available_now, poll)


def stream_enrich(ex_stream: DataFrame, opts: EnrichOptions | None = None) -> DataFrame:
    """Raw exchanges -> calls continuously (the batch job, per micro-batch, no state)."""
    return enrich_calls(ex_stream, opts)


def run_ingest(ex_stream: DataFrame, store_path: str, checkpoint: str, opts: EnrichOptions | None = None,
               exports: dict[str, str] | None = None, available_now: bool = False,
               poll: str = DEFAULT_POLL) -> StreamingQuery:
    """I5 + I6: enrich each micro-batch, append it to the store, then fan out to export sinks.

    ``exports`` maps a format name (jsonl, langfuse, langsmith, weave, otlp,
    phoenix) to an output folder; each batch is written under
    ``<folder>/batch=<epoch>`` so a replayed epoch overwrites itself.
    """
    calls = stream_enrich(ex_stream, opts)
    formats = {"jsonl": ex.jsonl, "langfuse": ex.langfuse, "langsmith": ex.langsmith, "weave": ex.weave,
               "otlp": ex.otlp_spans, "phoenix": ex.phoenix_spans}

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        append_calls(batch, store_path)
        for name, folder in (exports or {}).items():
            formats[name](batch).select("line").write.mode("overwrite").text(f"{folder}/batch={epoch}")
        batch.unpersist()

    return _start(calls.writeStream.foreachBatch(sink), checkpoint, available_now, poll)


def _last_alert(path: str, spark: SparkSession):
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.max("alerted_at").alias("t")).first()["t"]


def budget_monitor(stream: DataFrame, limit_usd: float, period: str, alerts_path: str, checkpoint: str,
                   as_of=None, available_now: bool = False, poll: str = "60 seconds") -> StreamingQuery:
    """I4: spend per budget period kept incrementally; alert when it reaches the limit.

    State: one running sum per period key (``date_trunc`` of the call time).
    Each micro-batch compares the current period's spend with the limit and
    appends an alert row unless one was written in the last 10 minutes (the
    throttle reads the persisted alert log, so it survives restarts).
    """
    unit = {"day": "day", "week": "week"}.get(period, "month")
    spend = stream.groupBy(F.date_trunc(unit, "call_ts").alias("period_start")).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"))
    spark = stream.sparkSession

    def check(batch: DataFrame, epoch: int) -> None:
        now = parse_since(as_of) if as_of is not None else utc_now()
        start = period_start(period, now)
        # the aggregate holds one row per period key; reading it whole also lets every
        # state partition of the micro-batch commit
        rows = batch.where(F.col("period_start") == ts_literal(start)).collect()
        spent = float(rows[0]["spent_usd"]) if rows else 0.0
        if spent < limit_usd:
            return
        last = _last_alert(alerts_path, spark)
        now_ts = now
        if last is not None and now_ts - last < ALERT_EVERY:
            return
        alert = spark.createDataFrame(
            [(unit, start, spent, float(limit_usd), now_ts, int(epoch))],
            "period string, period_start timestamp, spent_usd double, limit_usd double, "
            "alerted_at timestamp, epoch long")
        alert.write.mode("append").parquet(alerts_path)

    return _start(spend.writeStream.outputMode("complete").foreachBatch(check), checkpoint,
                  available_now, poll)


def running_spend(stream: DataFrame, out: str, checkpoint: str, f: CallFilter | None = None,
                  available_now: bool = False, poll: str = DEFAULT_POLL) -> StreamingQuery:
    """I8: every arriving call with the cost of all calls so far, itself included (``cum_cost``).

    Calls are summed in order of arrival: by micro-batch, within one by (call_ts, id), by the same
    slices as F1. The total before a micro-batch is that of the one before it, kept with its rows
    under ``out/epoch=..``; a replayed micro-batch overwrites its own folder with the same rows.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = (batch if f is None else f.apply(batch)).persist()
        before = spend_before(spark, out, epoch)
        summed = running_cost(rows).withColumn("cum_cost", F.col("cum_cost") + F.lit(before))
        summed.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        total = before + (rows.agg(F.sum("cost_usd")).first()[0] or 0.0)
        spark.createDataFrame([(total,)], "total double").write.mode("overwrite").parquet(f"{out}/totals/epoch={epoch}")
        rows.unpersist()

    return _start(stream.writeStream.foreachBatch(sink), checkpoint, available_now, poll)


def spend_before(spark: SparkSession, out: str, epoch: int) -> float:
    """Total after the latest micro-batch before ``epoch``."""
    totals = f"{out}/totals"
    if not _exists(spark, totals):
        return 0.0
    row = spark.read.schema("total double, epoch long").parquet(totals).where(F.col("epoch") < epoch).agg(F.max_by("total", "epoch")).first()
    return row[0] or 0.0


def store_spend(spark: SparkSession, store_path: str, period: str, now: dt.datetime) -> float:
    """Spend since the start of the period of ``now``, of the calls that the store holds; reads that period's days."""
    return metric_spend(load_calls(spark, store_path, with_partition=True), period, now)


def metric_spend(calls: DataFrame, period: str, now: dt.datetime) -> float:
    spent = with_time_window(calls, since=period_start(period, now)).where(F.col("call_ts") <= ts_literal(now))
    return float(spent.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0])


def clock(spark: SparkSession) -> DataFrame:
    """A stream of the time (``now``): Spark's rate source, one row a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("now"))


def budget_clock(ticks: DataFrame, spent, limit_usd: float, period: str, alerts_path: str, checkpoint: str,
                 available_now: bool = False, every: str = "60 seconds") -> StreamingQuery:
    """I4: check the budget by the clock, whether calls arrive or not.

    ``ticks`` is a stream of the time (``clock``), ``spent`` a function of (spark, time) that gives
    the spend of the time's period (``store_spend``). At each trigger the latest tick counts; a
    spend at or over the limit adds an alert unless the log has one of the ten minutes before. The
    log is what throttles, so neither a restart nor a replayed tick alerts twice.
    """
    unit = period if period in ("day", "week") else "month"

    def check(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.date_format(F.max("now"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
        if now is None:
            return
        now = parse_since(now)
        if (total := spent(spark, now)) < limit_usd:
            return
        last = _last_alert(alerts_path, spark)
        if last is not None and now - last < ALERT_EVERY:
            return
        spark.createDataFrame([(unit, period_start(period, now).isoformat(sep=" "), total, float(limit_usd), now.isoformat(sep=" "), int(epoch))],
                              "period string, period_start string, spent_usd double, limit_usd double, alerted_at string, epoch long").withColumns(
            {c: F.col(c).cast("timestamp") for c in ("period_start", "alerted_at")}).write.mode("append").parquet(alerts_path)

    return _start(ticks.writeStream.foreachBatch(check), checkpoint, available_now, every)


def watch_budget(stream: DataFrame, limit_usd: float, period: str, as_of=None) -> DataFrame:
    """I8: running spend of the current budget period with the budget line (integer percent, warn >= 80 %)."""
    start = period_start(period, as_of)
    cur = stream.where(F.col("call_ts") >= ts_literal(start))
    spent = cur.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"), F.count(F.lit(1)).alias("calls"))
    pct = F.when(F.lit(float(limit_usd)) > 0, F.floor(F.col("spent_usd") / F.lit(float(limit_usd)) * 100.0)) \
        .otherwise(F.lit(0)).cast("long")
    return spent.select("calls", "spent_usd", F.lit(float(limit_usd)).alias("limit_usd"), pct.alias("pct"),
                        (pct >= 80).alias("warn"))
