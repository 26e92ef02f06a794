"""Counter / histogram / gauge tables and their text exposition.

Each metric is one grouped aggregate. Histograms compute every cumulative
bucket as a ``count_if`` column in a single pass (no row explosion) and
unpivot only the small per-model result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.predicates import parse_since, status_class, ts_literal, utc_now, with_time_window

# Default cumulative histogram bounds in milliseconds (+Inf is implicit).
DEFAULT_BOUNDS_MS = (100, 500, 1000, 5000)
# Metric name prefix of the text exposition (configurable).
DEFAULT_PREFIX = "callscope"


def metric_calls(df: DataFrame) -> DataFrame:
    """Call counts by model, provider, status class."""
    return (df.groupBy("model", "provider", status_class().alias("status_class"))
            .agg(F.count(F.lit(1)).alias("n")))


def metric_tokens(df: DataFrame) -> DataFrame:
    """Sums of positive token counts by model, provider, type (input/output)."""
    agg = df.groupBy("model", "provider").agg(
        F.sum(F.when(F.col("input_tokens") > 0, F.col("input_tokens"))).alias("input"),
        F.sum(F.when(F.col("output_tokens") > 0, F.col("output_tokens"))).alias("output"))
    long = agg.select("model", "provider", F.expr("stack(2, 'input', input, 'output', output) AS (type, n)"))
    return long.where(F.col("n").isNotNull())


def metric_cost(df: DataFrame) -> DataFrame:
    """Sum of positive costs by model, provider."""
    return (df.where(F.col("cost_usd") > 0).groupBy("model", "provider")
            .agg(F.sum("cost_usd").alias("usd")))


def metric_hist(df: DataFrame, value: str = "latency_ms", bounds=DEFAULT_BOUNDS_MS) -> DataFrame:
    """Cumulative ``le`` buckets, sum and count per model over non-NULL values.

    Output rows: (model, le, n, sum, count) with ``le`` as text ('+Inf' last).
    """
    bounds = sorted(int(b) for b in bounds)
    v = F.col(value)
    aggs = [F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(v).alias("count"), F.sum(v).alias("sum")]
    per = df.where(v.isNotNull()).groupBy("model").agg(*aggs)
    pairs = [f"'{b}', b{i}" for i, b in enumerate(bounds)] + ["'+Inf', count"]
    stack = f"stack({len(pairs)}, {', '.join(pairs)}) AS (le, n)"
    return per.select("model", F.expr(stack), "sum", "count")


def metric_latency_hist(df: DataFrame, bounds=DEFAULT_BOUNDS_MS) -> DataFrame:
    return metric_hist(df, "latency_ms", bounds)


def metric_ttft_hist(df: DataFrame, bounds=DEFAULT_BOUNDS_MS) -> DataFrame:
    return metric_hist(df, "ttft_ms", bounds)


def metric_agent_calls(df: DataFrame) -> DataFrame:
    """Call count per non-NULL agent."""
    return (df.where(F.col("agent_name").isNotNull()).groupBy("agent_name")
            .agg(F.count(F.lit(1)).alias("n")))


def period_start(period: str, as_of) -> dt.datetime:
    """Start of the current budget period: day, week (Monday) or month (default)."""
    now = parse_since(as_of) if as_of is not None else utc_now()
    day = dt.datetime(now.year, now.month, now.day)
    if period == "day":
        return day
    if period == "week":
        return day - dt.timedelta(days=now.weekday())
    return dt.datetime(now.year, now.month, 1)


def metric_budget(df: DataFrame, limit_usd: float, period: str = "month", as_of=None) -> DataFrame:
    """Spend since the start of the period, limit, integer percent, warn flags."""
    start = period_start(period, as_of)
    lim = float(limit_usd)
    spent = (with_time_window(df, since=start)
             .agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd")))
    pct = F.when(F.lit(lim) > 0, F.floor(F.col("spent_usd") / F.lit(lim) * 100.0)).otherwise(F.lit(0)).cast("long")
    return spent.select(
        F.lit(period if period in ("day", "week") else "month").alias("period"),
        ts_literal(start).alias("period_start"),
        "spent_usd", F.lit(lim).alias("limit_usd"), pct.alias("pct"),
        (pct >= 80).alias("near_limit"), (F.col("spent_usd") >= F.lit(lim)).alias("over_limit"))





def measures(df: DataFrame, bounds, budget_start=None) -> DataFrame:
    """One aggregate carrying every measure of every metric family.

    Keyed by (model, provider, status_class, agent_name): a few hundred rows
    at most, from a single scan of the calls. Every family below is derived
    from this table, so the exposition reads the data once (the repeated
    table is checkpointed once).
    """
    lat, ttft, cost = F.col("latency_ms"), F.col("ttft_ms"), F.col("cost_usd")
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("input_tokens") > 0, F.col("input_tokens"))).alias("tok_in"),
            F.sum(F.when(F.col("output_tokens") > 0, F.col("output_tokens"))).alias("tok_out"),
            F.sum(F.when(cost > 0, cost)).alias("usd"),
            F.count(lat).alias("lat_n"), F.sum(lat).alias("lat_sum"),
            F.count(ttft).alias("ttft_n"), F.sum(ttft).alias("ttft_sum")]
    aggs += [F.count_if(lat <= b).alias(f"lat_b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count_if(ttft <= b).alias(f"ttft_b{i}") for i, b in enumerate(bounds)]
    if budget_start is not None:
        aggs.append(F.sum(F.when(F.col("call_ts") >= ts_literal(budget_start), cost)).alias("spent"))
    return df.groupBy("model", "provider", status_class().alias("status_class"), "agent_name").agg(*aggs)


def families(m: DataFrame, bounds) -> dict[str, DataFrame]:
    """The six metric families (as D24-D29 give them) from the rows of ``measures``."""
    def hist(kind: str) -> DataFrame:
        per = m.groupBy("model").agg(*[F.sum(f"{kind}_b{i}").alias(f"b{i}") for i in range(len(bounds))],
                                     F.sum(f"{kind}_sum").alias("sum"), F.sum(f"{kind}_n").alias("count")).where("count > 0")
        pairs = ", ".join([f"'{b}', b{i}" for i, b in enumerate(bounds)] + ["'+Inf', count"])
        return per.select("model", F.expr(f"stack({len(bounds) + 1}, {pairs}) AS (le, n)"), "sum", "count")

    tokens = m.groupBy("model", "provider").agg(F.sum("tok_in").alias("input"), F.sum("tok_out").alias("output"))
    return {
        "calls": m.groupBy("model", "provider", "status_class").agg(F.sum("n").alias("n")),
        "tokens": tokens.select("model", "provider", F.expr("stack(2, 'input', input, 'output', output) AS (type, n)")).where("n is not null"),
        "cost": m.where("usd is not null").groupBy("model", "provider").agg(F.sum("usd").alias("usd")),
        "latency": hist("lat"), "ttft": hist("ttft"),
        "agents": m.where("agent_name is not null").groupBy("agent_name").agg(F.sum("n").alias("n")),
    }


def metrics_exposition(df: DataFrame, bounds=DEFAULT_BOUNDS_MS, prefix: str = DEFAULT_PREFIX,
                       budget: tuple[float, str, object] | None = None) -> DataFrame:
    """The text exposition as rows ``(family, seq, k, line)``.

    ``family`` orders metric families; within a family ``seq`` orders HELP,
    TYPE and sample lines and ``k`` orders samples by their labels. Write
    them sorted with ``orderBy('family', 'seq', 'k')`` to get the document.
    """
    spark = df.sparkSession
    p = prefix
    bounds = sorted(int(b) for b in bounds)
    start = period_start(budget[1], budget[2]) if budget is not None else None
    # the measure table is tiny; checkpoint it (shared checkpoint folder) so the
    # calls are scanned once and every family below reads the same snapshot
    from callscope.session import checkpoint_root

    checkpoint_root(spark)
    m = measures(df, bounds, start).checkpoint(eager=True)
    parts = []

    def header(fam: int, name: str, help_: str, typ: str):
        return spark.createDataFrame(
            [(fam, 0, "", f"# HELP {p}_{name} {help_}"), (fam, 1, "", f"# TYPE {p}_{name} {typ}")],
            "family int, seq int, k string, line string")

    def row(fam, seq, k, line):
        return F.lit(fam).alias("family"), F.lit(seq).alias("seq"), k.alias("k"), line.alias("line")

    calls = m.groupBy("model", "provider", "status_class").agg(F.sum("n").alias("n"))
    parts += [header(1, "calls_total", "Calls in the table, by model, provider and status class", "counter"), calls.select(*row(
        1, 2, F.concat_ws("\u0001", "model", "provider", "status_class"),
        F.format_string(f'{p}_calls_total{{model="%s",provider="%s",status_class="%s"}} %d',
                        "model", "provider", "status_class", "n")))]
    mp = m.groupBy("model", "provider").agg(F.sum("tok_in").alias("tin"), F.sum("tok_out").alias("tout"),
                                            F.sum("usd").alias("usd"))
    parts.append(header(2, "tokens_total", "Tokens of the calls, by direction", "counter"))
    for seq, col, typ in ((2, "tin", "input"), (3, "tout", "output")):
        parts.append(mp.where(F.col(col).isNotNull()).select(*row(
            2, seq, F.concat_ws("\u0001", "model", "provider"),
            F.format_string(f'{p}_tokens_total{{model="%s",provider="%s",type="{typ}"}} %d',
                            "model", "provider", col))))
    parts += [header(3, "cost_usd_total", "Estimated cost of the calls in USD", "counter"),
              mp.where(F.col("usd").isNotNull()).select(*row(
                  3, 2, F.concat_ws("\u0001", "model", "provider"),
                  F.format_string(f'{p}_cost_usd_total{{model="%s",provider="%s"}} %.8f', "model", "provider", "usd")))]
    for fam, pre, name, help_ in ((4, "lat", "latency_ms", "Latency of the calls, milliseconds"),
                                  (5, "ttft", "ttft_ms", "Wait for the first token, milliseconds")):
        h = (m.groupBy("model").agg(F.sum(f"{pre}_n").alias("cnt"), F.sum(f"{pre}_sum").alias("total"),
                                    *[F.sum(f"{pre}_b{i}").alias(f"b{i}") for i in range(len(bounds))])
             .where(F.col("cnt") > 0))
        pairs = [f"'{b}', {str(b).rjust(12, '0')!r}, b{i}" for i, b in enumerate(bounds)]
        pairs.append(f"'+Inf', {str(1 << 30).rjust(12, '0')!r}, cnt")
        buckets = h.select("model", F.expr(f"stack({len(pairs)}, {', '.join(pairs)}) AS (le, ord, v)"))
        parts += [header(fam, name, help_, "histogram"),
                  buckets.select(*row(fam, 2, F.concat_ws("\u0001", "model", "ord"), F.format_string(
                      f'{p}_{name}_bucket{{model="%s",le="%s"}} %d', "model", "le", "v"))),
                  h.select(*row(fam, 2, F.concat_ws("\u0001", "model", F.lit("~1sum")), F.format_string(
                      f'{p}_{name}_sum{{model="%s"}} %.0f', "model", F.col("total").cast("double")))),
                  h.select(*row(fam, 2, F.concat_ws("\u0001", "model", F.lit("~2count")), F.format_string(
                      f'{p}_{name}_count{{model="%s"}} %d', "model", "cnt")))]
    agents = m.where(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(F.sum("n").alias("n"))
    parts += [header(6, "agent_calls_total", "Calls of each agent", "counter"),
              agents.select(*row(6, 2, F.col("agent_name"), F.format_string(
                  f'{p}_agent_calls_total{{agent="%s"}} %d', "agent_name", "n")))]
    if budget is not None:
        lim, period, _as_of = budget
        per = period if period in ("day", "week") else "month"
        spent = m.agg(F.coalesce(F.sum("spent"), F.lit(0.0)).alias("spent"))
        gl = spent.select(*row(8, 2, F.lit(""), F.format_string(f'{p}_budget_spent_usd{{period="{per}"}} %.8f', "spent")))
        limit = spark.range(1).select(*row(9, 2, F.lit(""), F.format_string(f'{p}_budget_limit_usd{{period="{per}"}} %.8f', F.lit(float(lim)))))
        parts += [header(8, "budget_spent_usd", "Spend in the running budget period, USD",
                         "gauge"), gl,
                  header(9, "budget_limit_usd", "Limit of a budget period, USD", "gauge"), limit]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out.select("family", "seq", "k", "line")
