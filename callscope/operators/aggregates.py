"""Grouped and global aggregates over the calls table.

All are single partial/final hash aggregates; bodies are never read, so the
parquet scan is pruned to the few columns each aggregate touches.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.predicates import (
    CallFilter,
    is_error_a,
    is_error_b,
    parse_since,
    ts_literal,
    utc_now,
    with_time_window,
)
from callscope.operators.filters import _limit
from callscope.operators.percentiles import exact_percentiles


def _as_of(as_of) -> dt.datetime:
    return parse_since(as_of) if as_of is not None else utc_now()


def _ts(value: dt.datetime) -> Column:
    return ts_literal(value)


def total_cost_col(name: str = "total_cost_usd") -> Column:
    return F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias(name)


def avg_latency_col(name: str = "avg_latency_ms") -> Column:
    return F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias(name)


def error_count_col(pred: Column | None = None, name: str = "error_count") -> Column:
    return F.count_if(pred if pred is not None else is_error_a()).alias(name)


def _token_cols() -> list[Column]:
    return [F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens")]


def total_calls(df: DataFrame) -> DataFrame:
    """D1."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def stats(df: DataFrame, as_of=None) -> DataFrame:
    """Global totals in one pass; ``calls_last_hour`` relative to ``as_of``."""
    hour_ago = _as_of(as_of) - dt.timedelta(hours=1)
    return df.agg(
        F.count(F.lit(1)).alias("total_calls"), *_token_cols(), total_cost_col(), avg_latency_col(),
        error_count_col(), F.count_if(F.col("call_ts") >= _ts(hour_ago)).alias("calls_last_hour"))


def error_rate(df: DataFrame) -> DataFrame:
    """D3: errors (predicate A) over calls, 0 when empty; also as a percentage."""
    agg = df.agg(F.count(F.lit(1)).alias("total_calls"), error_count_col())
    rate = F.when(F.col("total_calls") > 0, F.col("error_count") / F.col("total_calls")).otherwise(F.lit(0.0))
    return agg.select("total_calls", "error_count", rate.alias("error_rate"),
                      (rate * 100.0).alias("error_rate_pct"))


def _by(df: DataFrame, key: str, tokens: bool = True) -> DataFrame:
    cols = [F.count(F.lit(1)).alias("calls")]
    if tokens:
        cols += _token_cols()
    cols += [total_cost_col(), avg_latency_col(), error_count_col(), F.sum("cost_usd").alias("_order")]
    return (df.groupBy(key).agg(*cols)
            .orderBy(F.col("_order").desc_nulls_last(), F.col(key)).drop("_order"))


def stats_by_model(df: DataFrame) -> DataFrame:
    """Per model; most expensive first (NULL cost sums last)."""
    return _by(df, "model")


def stats_by_endpoint(df: DataFrame) -> DataFrame:
    """D5."""
    return _by(df, "endpoint")


def stats_by_provider(df: DataFrame) -> DataFrame:
    """As D4 without token totals."""
    return _by(df, "provider", tokens=False)


def _restrict(f: CallFilter | None) -> CallFilter:
    """The filter fields honoured by the agent / workflow summaries."""
    f = f or CallFilter()
    return CallFilter(since=f.since, until=f.until, provider=f.provider, model=f.model)


def stats_by_agent(df: DataFrame, f: CallFilter | None = None) -> DataFrame:
    """Per non-NULL agent under since/until/provider/model."""
    base = _restrict(f).apply(df).where(F.col("agent_name").isNotNull())
    return _by(base, "agent_name")


def _workflow_summary(df: DataFrame, err: Column) -> DataFrame:
    """Per-workflow totals with an exact distinct-agent count.

    Two hash aggregates instead of an Expand-based distinct aggregate: first
    by (workflow, agent) with partial sums, then by workflow, counting the
    non-NULL agents. Both levels combine map-side, so a hot workflow is
    reduced before its shuffle.
    """
    per_agent = df.groupBy("workflow_id", "agent_name").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("cost_usd").alias("_cost"),
        F.sum("latency_ms").alias("_lat"), F.count_if(err).alias("_err"),
        F.min("call_ts").alias("_first"), F.max("call_ts").alias("_last"))
    return per_agent.groupBy("workflow_id").agg(
        F.sum("_c").alias("calls"), F.coalesce(F.sum("_cost"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.sum("_lat"), F.lit(0)).alias("total_latency_ms"),
        F.count("agent_name").alias("agents"), F.sum("_err").alias("error_count"),
        F.min("_first").alias("first_call"), F.max("_last").alias("last_call"))


def workflow_summary(df: DataFrame, f: CallFilter | None = None) -> DataFrame:
    """Per workflow; newest first call first."""
    base = _restrict(f).apply(df).where(F.col("workflow_id").isNotNull())
    return _workflow_summary(base, is_error_a()).orderBy(F.col("first_call").desc(), "workflow_id")


def workflow_recent(df: DataFrame, limit: int = 20) -> DataFrame:
    """Most recently active workflows, errors by predicate B, the first ``limit``."""
    n = _limit(limit)
    return (_workflow_summary(df.where(F.col("workflow_id").isNotNull()), is_error_b())
            .orderBy(F.col("last_call").desc(), "workflow_id").limit(n))


def daily_stats(df: DataFrame, days: int = 90, as_of=None) -> DataFrame:
    """Per UTC day over the last ``days`` days ; empty days omitted."""
    if int(days) < 1:
        raise ValueError(f"at least one day is needed: {days}")
    days = int(days)
    start = _as_of(as_of) - dt.timedelta(days=days)
    return (with_time_window(df, since=start)
            .groupBy(F.to_date("call_ts").alias("date"))
            .agg(F.count(F.lit(1)).alias("calls"), total_cost_col("cost_usd"),
                 error_count_col(), avg_latency_col())
            .orderBy("date"))


def cost_since(df: DataFrame, since) -> DataFrame:
    """Total cost at or after an instant."""
    return with_time_window(df, since=since).agg(total_cost_col("cost"))


def cost_report(df: DataFrame, f: CallFilter | None = None, fail_over_usd: float | None = None) -> DataFrame:
    """D12 (+J2): per-model report plus a grand-total row (``model`` NULL, ``is_total``).

    One ``rollup`` pass yields both levels. ``over_budget`` is set on the total
    row when ``fail_over_usd`` is given and the total exceeds it.
    """
    f = f or CallFilter()
    base = CallFilter(model=f.model, provider=f.provider, since=f.since, until=f.until).apply(df)
    rep = (base.rollup("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.grouping("model").alias("_g")))
    rep = rep.withColumn("is_total", F.col("_g") == 1).drop("_g")
    over = (F.col("is_total") & (F.col("cost_usd") > F.lit(float(fail_over_usd)))) \
        if fail_over_usd is not None else F.lit(False)
    return (rep.withColumn("over_budget", over)
            .orderBy(F.col("is_total"), F.col("cost_usd").desc(), F.col("model")))


def eval_stats(df: DataFrame, f: CallFilter | None = None) -> DataFrame:
    """Totals, errors (B), rate, p99 latency, average cost under the filter.

    Honours model, provider, since/until and status/status range. Totals are
    one global aggregate, p99 the two-level exact percentile; the two
    one-row results are combined by a union + aggregate (no join).
    """
    f = f or CallFilter()
    base = CallFilter(model=f.model, provider=f.provider, since=f.since, until=f.until,
                      status=f.status, status_range=f.status_range).apply(df)
    none_l = F.lit(None).cast("long")
    tot = base.agg(F.count(F.lit(1)).alias("total_calls"), error_count_col(is_error_b()),
                   F.avg("cost_usd").alias("avg_cost_usd")).withColumn("latency_p99", none_l)
    p99 = exact_percentiles(base, "latency_ms", ps=(99,)).select(
        none_l.alias("total_calls"), none_l.alias("error_count"), F.lit(None).cast("double").alias("avg_cost_usd"),
        F.col("p99").cast("long").alias("latency_p99"))
    agg = tot.unionByName(p99).agg(
        F.coalesce(F.max("total_calls"), F.lit(0)).alias("total_calls"),
        F.coalesce(F.max("error_count"), F.lit(0)).alias("error_count"),
        F.coalesce(F.max("latency_p99"), F.lit(0)).alias("latency_p99"),
        F.coalesce(F.max("avg_cost_usd"), F.lit(0.0)).alias("avg_cost_usd"))
    rate = F.when(F.col("total_calls") > 0, F.col("error_count") / F.col("total_calls")).otherwise(0.0)
    return agg.select("total_calls", "error_count", rate.alias("error_rate"),
                      "latency_p99", "avg_cost_usd")


def compare_models(df: DataFrame, model_a: str, model_b: str, since=None, until=None) -> DataFrame:
    """Side-by-side stats for two exact model names; an absent model is a zero row."""
    spark = df.sparkSession
    base = df.where(F.col("model").isin(model_a, model_b))
    base = with_time_window(base, since, until)
    agg = base.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("avg_cost_usd"),
        total_cost_col(), avg_latency_col(),
        F.coalesce(F.avg("input_tokens"), F.lit(0.0)).alias("avg_input_tokens"),
        F.coalesce(F.avg("output_tokens"), F.lit(0.0)).alias("avg_output_tokens"),
        error_count_col(is_error_b()))
    p99 = exact_percentiles(base, "latency_ms", by=["model"], ps=(99,)).withColumnRenamed("p99", "latency_p99")
    pair = spark.createDataFrame([(0, model_a), (1, model_b)], "side int, model string")
    out = pair.join(agg, "model", "left").join(p99, "model", "left")
    calls = F.coalesce("calls", F.lit(0))
    return out.select(
        "side", "model", calls.alias("calls"),
        F.coalesce("avg_cost_usd", F.lit(0.0)).alias("avg_cost_usd"),
        F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce("avg_latency_ms", F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce("latency_p99", F.lit(0)).alias("latency_p99"),
        F.when(calls > 0, F.col("error_count") / calls).otherwise(F.lit(0.0)).alias("error_rate"),
        F.coalesce("avg_input_tokens", F.lit(0.0)).alias("avg_input_tokens"),
        F.coalesce("avg_output_tokens", F.lit(0.0)).alias("avg_output_tokens"),
    ).orderBy("side")


def model_breakdown(df: DataFrame) -> DataFrame:
    """D4 joined with each model's exact p99 latency."""
    p99 = exact_percentiles(df, "latency_ms", by=["model"], ps=(99,)).withColumnRenamed("p99", "latency_p99")
    base = df.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), *_token_cols(), total_cost_col(), avg_latency_col(),
        error_count_col(), F.sum("cost_usd").alias("_order"))
    return (base.join(p99, "model", "left")
            .orderBy(F.col("_order").desc_nulls_last(), "model").drop("_order"))


def workflow_agents(df: DataFrame, workflow_id: str) -> DataFrame:
    """D20 as rows: one workflow's totals per agent (a row with a null agent for calls without one)."""
    return df.where(F.col("workflow_id") == workflow_id).groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("calls"), total_cost_col(),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("total_latency_ms"), error_count_col())


def workflow_detail(df: DataFrame, workflow_id: str) -> DataFrame:
    """One workflow's totals with its sorted distinct agents.

    Calls are reduced to a row per agent first, so only the list that is the result meets in one row.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return workflow_agents(df, workflow_id).agg(
        F.lit(workflow_id).alias("workflow_id"), total("calls"),
        F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd"), total("total_latency_ms"),
        F.array_sort(F.collect_list("agent_name")).alias("agents"),
        F.count("agent_name").alias("agent_count"), total("error_count"))


def workflow_costs_recent(df: DataFrame, n: int = 1000) -> DataFrame:
    """Per-workflow count and cost over the newest ``n`` calls."""
    from callscope.operators.filters import list_calls

    recent = list_calls(df.select("id", "call_ts", "workflow_id", "cost_usd"), None, n)
    return (recent.where(F.col("workflow_id").isNotNull()).groupBy("workflow_id")
            .agg(F.count(F.lit(1)).alias("calls"), total_cost_col("cost_usd")))


# Latency histogram bucket upper bounds (ms), last bucket open.
LATENCY_BUCKETS = [(100, "<100ms"), (250, "100-250ms"), (500, "250-500ms"), (1000, "500ms-1s"),
                   (2000, "1-2s"), (5000, "2-5s"), (None, ">=5s")]


def latency_histogram(df: DataFrame) -> DataFrame:
    """Seven disjoint latency buckets, zero-filled."""
    spark = df.sparkSession
    lat = F.col("latency_ms")
    b = None
    for i, (hi, _) in enumerate(LATENCY_BUCKETS):
        if hi is None:
            b = b.otherwise(F.lit(i))
        else:
            b = F.when(lat < hi, F.lit(i)) if b is None else b.when(lat < hi, F.lit(i))
    counts = df.where(lat.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(i, lbl) for i, (_, lbl) in enumerate(LATENCY_BUCKETS)],
                                "bucket int, label string")
    return (F.broadcast(dim).join(counts, "bucket", "left")
            .select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bucket"))


def agent_rows(df: DataFrame) -> DataFrame:
    """D23 as rows: every distinct agent with its calls."""
    return df.where(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(F.count(F.lit(1)).alias("calls"))


def distinct_agents(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Count (exact or HLL) and sorted list of distinct agents, which are reduced to a row each first."""
    if approximate:
        return df.agg(F.approx_count_distinct("agent_name").alias("n"), F.array_sort(F.collect_set("agent_name")).alias("agents"))
    return agent_rows(df).agg(F.count("agent_name").alias("n"), F.array_sort(F.collect_list("agent_name")).alias("agents"))


def listing_total(df: DataFrame, f: CallFilter | None = None, limit: int = 100) -> DataFrame:
    """Count and total cost of the listed page."""
    from callscope.operators.filters import list_calls

    page = list_calls(df, f, limit)
    return page.agg(F.count(F.lit(1)).alias("calls"), total_cost_col("cost_usd"))


def top_models_by_cost(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most expensive models."""
    return (df.groupBy("model").agg(total_cost_col("cost_usd"))
            .orderBy(F.col("cost_usd").desc(), "model").limit(n))


def provider_cost_share(df: DataFrame) -> DataFrame:
    """D34 companion: each provider's share of total cost."""
    from pyspark.sql import Window

    per = df.groupBy("provider").agg(total_cost_col("cost_usd"))
    tot = F.sum("cost_usd").over(Window.partitionBy())
    return per.withColumn("share", F.when(tot > 0, F.col("cost_usd") / tot).otherwise(0.0))
