"""Exact rank percentiles.

The rank rule is ``sorted[min(n*p div 100, n-1)]`` (0-based, integer
division), which is none of Spark's built-in percentile functions.

Plan (two levels, every step a keyed aggregate or a small window):

1. value histogram ``(group, value, count)`` -- partial/final hash
   aggregate, the shuffle carries one row per distinct value per partition;
2. coarse histogram over value buckets (``value >> 10``) with a running
   count per group: locates, for each requested p, the bucket holding the
   target rank and the rank offset inside it;
3. the fine histogram rows of the target buckets only (at most 1024
   distinct values each) get a running count per (group, p); the answer is
   the smallest value whose running count exceeds the offset.

No task ever holds a group's rows or all of its distinct values: the
windows see at most (value range / 1024) buckets or 1024 values, so a hot
group (a third of all rows) costs the same as any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PS = (50, 95, 99)
BUCKET_BITS = 10


def exact_percentiles(df: DataFrame, value: str, by: Sequence[str] = (),
                      ps: Sequence[int] = DEFAULT_PS, prefix: str = "p",
                      with_count: bool = False) -> DataFrame:
    """Exact percentiles of integral ``value`` per ``by`` group (NULL values ignored).

    Output: ``by`` columns, then ``{prefix}{p}`` per requested p (same type
    as ``value``). Without ``by`` there is always exactly one row and an
    empty input yields zeros.
    """
    keys = list(by)
    vtype = df.schema[value].dataType
    if not isinstance(vtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"exact_percentiles needs an integral column, got {vtype}")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return histogram_percentiles(counts, value, keys, ps, prefix, with_count)


def histogram_percentiles(counts: DataFrame, value: str, by: Sequence[str] = (), ps: Sequence[int] = DEFAULT_PS,
                          prefix: str = "p", with_count: bool = False) -> DataFrame:
    """``exact_percentiles`` of a value histogram: ``by`` columns, ``value`` and its count ``_c``, one row each."""
    keys = list(by)
    vtype = counts.schema[value].dataType
    hist = counts.withColumn("_b", F.shiftright(F.col(value).cast("long"), BUCKET_BITS))
    # level 2: coarse buckets with running counts
    part = Window.partitionBy(*keys) if keys else Window.partitionBy()
    coarse = hist.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    coarse = (coarse.withColumn("_bcum", F.sum("_bc").over(
        part.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_n", F.sum("_bc").over(part)))
    want = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("p"),
                                        F.least(F.expr(f"(_n * {int(p)}) div 100"), F.col("_n") - 1).alias("idx"))
                               for p in ps])).alias("_t")
    targets = (coarse.select(*keys, "_b", "_bc", "_bcum", "_n", want)
               .where((F.col("_t.idx") < F.col("_bcum")) & (F.col("_t.idx") >= F.col("_bcum") - F.col("_bc")))
               .select(*keys, "_b", "_n", F.col("_t.p").alias("_p"),
                       (F.col("_t.idx") - (F.col("_bcum") - F.col("_bc"))).alias("_off")))
    # level 3: exact running counts inside the target buckets only
    fine = hist.join(targets, [*keys, "_b"])
    w = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("_cum", F.sum("_c").over(w))
    hits = (fine.where(F.col("_cum") > F.col("_off"))
            .groupBy(*keys, "_p").agg(F.min(value).alias("_v"), F.max("_n").alias("_n")))
    aggs = [F.max(F.when(F.col("_p") == int(p), F.col("_v"))).alias(f"{prefix}{p}") for p in ps]
    if with_count:
        aggs.append(F.max("_n").alias("n"))
    if keys:
        return hits.groupBy(*keys).agg(*aggs)
    out = hits.agg(*aggs)
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast(
        vtype if c != "n" else T.LongType()).alias(c) for c in out.columns])


def latency_percentiles(df: DataFrame, f=None) -> DataFrame:
    """p50/p95/p99 of latency over the filtered calls; zeros when empty."""
    if f is not None:
        df = f.apply(df)
    return exact_percentiles(df, "latency_ms")


def latency_percentiles_by_model(df: DataFrame, f=None) -> DataFrame:
    """The same, one row per model."""
    if f is not None:
        df = f.apply(df)
    return exact_percentiles(df, "latency_ms", by=["model"])


def token_percentiles(df: DataFrame, since=None) -> DataFrame:
    """input/output token percentiles over calls with known input tokens.

    NULL output counts as 0. Both columns are unpivoted into one histogram
    job (one shuffle) and pivoted back to a single row.
    """
    from callscope.functions.predicates import with_time_window

    base = df.where(F.col("input_tokens").isNotNull())
    if since is not None:
        base = with_time_window(base, since=since)
    long = base.select(F.explode(F.array(
        F.struct(F.lit("input").alias("kind"), F.col("input_tokens").alias("v")),
        F.struct(F.lit("output").alias("kind"), F.coalesce("output_tokens", F.lit(0)).alias("v")),
    )).alias("x")).select("x.kind", "x.v")
    return pivot_tokens(exact_percentiles(long, "v", by=["kind"]))


def pivot_tokens(pct: DataFrame) -> DataFrame:
    """One row of the percentiles by ``kind`` (input, output); zeros where a kind has none."""
    return pct.agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col(f"p{p}"))), F.lit(0)).alias(f"{k}_p{p}")
                    for k in ("input", "output") for p in DEFAULT_PS])
