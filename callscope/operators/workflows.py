"""Trace and workflow timelines, running cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.filters import call_by_prefix


def trace_siblings(df: DataFrame, id_prefix: str) -> DataFrame:
    """Every call sharing the looked-up call's trace, oldest first.

    The lookup yields at most one row (B14), so joining it back on
    ``trace_id`` broadcasts a one-row side. Flags: ``is_root`` (no parent)
    and ``is_self`` (the looked-up call).
    """
    me = call_by_prefix(df.select("id", "call_ts", "trace_id"), id_prefix).select(
        F.col("id").alias("_self_id"), "trace_id")
    return (df.join(F.broadcast(me), "trace_id", "inner")
            .withColumn("is_root", F.col("parent_id").isNull())
            .withColumn("is_self", F.col("id") == F.col("_self_id"))
            .drop("_self_id")
            .orderBy("call_ts", "id"))


def workflow_timeline(df: DataFrame, workflow_id: str) -> DataFrame:
    """C11: one workflow's calls ascending; ``is_child`` when the parent is in the workflow.

    Existence test as a left join against the workflow's distinct ids.
    """
    wf = df.where(F.col("workflow_id") == workflow_id)
    ids = wf.select(F.col("id").alias("_pid")).distinct().withColumn("is_child", F.lit(True))
    return (wf.join(ids, wf["parent_id"] == ids["_pid"], "left")
            .withColumn("is_child", F.coalesce("is_child", F.lit(False)))
            .drop("_pid").orderBy("call_ts", "id"))


#: Rows of the sample for each splitter of the global order.
SAMPLED = 64


def order_splitters(df: DataFrame, n: int) -> list[tuple]:
    """At most ``n - 1`` (call_ts in microseconds, id) pairs that cut the rows, in that order, into slices of about equal size.

    Quantiles of a sample chosen by a hash of the id, of about ``SAMPLED`` rows a slice whatever
    the number of rows; splitters are of ids too, so that calls of one instant can be cut.
    """
    rows = df.count()
    keep = max(1, rows // (n * SAMPLED))
    sample = df.where(F.pmod(F.xxhash64("id", "call_ts"), F.lit(keep)) == 0).select(F.unix_micros("call_ts").alias("t"), "id").orderBy("t", "id").collect()
    picked = [tuple(sample[len(sample) * k // n]) for k in range(1, n)] if sample else []
    return sorted({p for p in picked if p[0] is not None and p[1] is not None})


def _slice(splitters: list[tuple]):
    """Number of the splitters at or before a row, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    at = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(i).alias("id")) for t, i in splitters])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])
    own = F.struct(F.unix_micros("call_ts").alias("t"), F.col("id").alias("id"))
    return F.aggregate(steps, F.lit(0), lambda a, step: F.when(F.coalesce(F.get(at, a + step - 1) <= own, F.lit(False)), a + step).otherwise(a))


def running_cost(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """cumulative cost (NULL as 0) in (call_ts, id) order.

    Scales without a global window in one task: literal splitters of the global order deal the rows
    into slices, a window sums up within each slice, and the slices' totals (one row each, from an
    aggregate of its own) give every slice what stands before it. The splitters are constants of
    the plan, so a lost task is run again with the same slices; no row is checkpointed and none
    leaves the JVM.
    """
    n = 3 * (partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = df.select("id", "call_ts", "model", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"))
    sliced = base.withColumn("_slice", _slice(order_splitters(base, n)))
    totals = sliced.groupBy("_slice").agg(F.sum("cost_usd").alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_slice", F.coalesce(before, F.lit(0.0)).alias("_off"))
    upto = Window.partitionBy("_slice").orderBy("call_ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("_local", F.sum("cost_usd").over(upto))
    return local.join(offsets, "_slice").select("id", "call_ts", "model", "cost_usd", (F.col("_local") + F.col("_off")).alias("cum_cost"))


def workflow_gantt(df: DataFrame, workflow_id: str | None = None) -> DataFrame:
    """per call, left offset and width as % of its workflow's time span.

    span = max(start + latency) - min(start) in ms (0 -> 1); width is at
    least 1 %. The span is a partial/final aggregate per workflow joined
    back on the key (no per-workflow window, so a hot workflow is reduced
    map-side and the join can be split by AQE skew handling).
    """
    base = df.where(F.col("workflow_id").isNotNull())
    if workflow_id is not None:
        base = base.where(F.col("workflow_id") == workflow_id)
    t0 = F.unix_millis("call_ts")
    base = base.select("workflow_id", "id", "call_ts", "latency_ms", t0.alias("_t0"),
                       (t0 + F.coalesce("latency_ms", F.lit(0))).alias("_t1"))
    spans = base.groupBy("workflow_id").agg(F.min("_t0").alias("_mn"), F.max("_t1").alias("_mx"))
    span = F.when(F.col("_mx") - F.col("_mn") == 0, F.lit(1)).otherwise(F.col("_mx") - F.col("_mn"))
    return base.join(spans, "workflow_id").select(
        "workflow_id", "id", "call_ts", "latency_ms",
        ((F.col("_t0") - F.col("_mn")) / span * 100.0).alias("left_pct"),
        F.greatest(F.coalesce("latency_ms", F.lit(0)) / span * 100.0, F.lit(1.0)).alias("width_pct"))

