"""Registered store queries: load, append, retention and key/value meta."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.plans.catalog import AS_OF, calls, register
from callscope.plans.q_aggregates import pct
from callscope.schema import CALL_COLUMNS
from callscope.session import scratch_dir
from callscope.sources import store as st
from callscope.sources.histograms import DayHistograms
from callscope.sources.ids import IdIndex

ALL = ", ".join(CALL_COLUMNS)


@register("load_calls", f"SELECT {ALL} FROM calls", raw=True)
def q_load_calls(spark, sf):
    """A1: calls written to a date-partitioned store and read back with the fixed schema."""
    path = scratch_dir(spark, "store")
    calls(spark, sf).withColumn("call_date", F.to_date("call_ts")).write.mode("overwrite").partitionBy("call_date").parquet(path)
    return st.load_calls(spark, path)


@register("append_calls", f"SELECT {ALL} FROM calls", raw=True)
def q_append_calls(spark, sf):
    """A2: the same calls appended twice plus a repeated slice; ids stay unique (first wins)."""
    path = scratch_dir(spark, "store")
    c = calls(spark, sf)
    st.append_calls(c, path)
    st.append_calls(c.unionByName(c.where(F.col("status_code") >= 400)), path)
    return st.load_calls(spark, path)


@register("prune", f"SELECT {ALL} FROM calls WHERE call_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 12 DAY", raw=True)
def q_prune(spark, sf):
    """Retention of 12 days at as_of; the kept rows of the store."""
    path = scratch_dir(spark, "store")
    st.append_calls(calls(spark, sf), path)
    st.prune_older_than(spark, path, 12, AS_OF)
    return st.load_calls(spark, path)


@register("latest_by_key", """SELECT agent_name AS key, arg_max(model, (call_ts, model)) AS value
  FROM calls WHERE agent_name IS NOT NULL GROUP BY agent_name""")
def q_latest_by_key(spark, sf):
    """Last-write-wins value per key over an upsert log (agent -> model of its latest call)."""
    meta = calls(spark, sf).where(F.col("agent_name").isNotNull()).select(
        F.col("agent_name").alias("key"), F.col("model").alias("value"), F.col("call_ts").alias("updated_at"))
    return st.latest_by_key(meta)


@register("stored_ids", "SELECT id, CAST(call_ts AS DATE) AS call_date FROM calls")
def q_stored_ids(spark, sf):
    """A2: the id index of a store that three overlapping appends filled."""
    path = scratch_dir(spark, "store")
    c = calls(spark, sf)
    for part in (c.where("status_code >= 400"), c.where("model like 'gpt%' or status_code >= 400"), c):
        st.append_calls(part, path)
    return IdIndex(spark, path).rows().select("id", "call_date").distinct()


def _kept_histograms(spark, sf):
    """Histograms of a store that three overlapping appends filled."""
    path = scratch_dir(spark, "store")
    DayHistograms(spark, path).create()
    c = calls(spark, sf)
    for part in (c.where("status_code >= 400"), c.where("model like 'gpt%' or status_code >= 400"), c):
        st.append_calls(part, path)
    return DayHistograms(spark, path)


_DAYS = "CAST(call_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-16'"


@register("day_latency_percentiles", f"""SELECT model, {pct('latency_ms', 50)} AS p50, {pct('latency_ms', 95)} AS p95, {pct('latency_ms', 99)} AS p99
  FROM calls WHERE {_DAYS} GROUP BY model""")
def q_day_latency_percentiles(spark, sf):
    """D16 of a range of days, from the value histograms kept with the store."""
    return _kept_histograms(spark, sf).latency_percentiles_by_model("2024-01-05", "2024-01-16")


@register("day_token_percentiles", f"""SELECT coalesce({pct('input_tokens', 50)}, 0) AS input_p50, coalesce({pct('input_tokens', 95)}, 0) AS input_p95,
  coalesce({pct('input_tokens', 99)}, 0) AS input_p99, coalesce({pct('o', 50)}, 0) AS output_p50, coalesce({pct('o', 95)}, 0) AS output_p95,
  coalesce({pct('o', 99)}, 0) AS output_p99
  FROM (SELECT input_tokens, coalesce(output_tokens, 0) AS o FROM calls WHERE input_tokens IS NOT NULL AND {_DAYS})""")
def q_day_token_percentiles(spark, sf):
    """D17 of a range of days, from the value histograms kept with the store."""
    return _kept_histograms(spark, sf).token_percentiles("2024-01-05", "2024-01-16")
