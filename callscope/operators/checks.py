"""Model comparison deltas and pass/fail rules."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.predicates import CallFilter
from callscope.operators.aggregates import compare_models, cost_report, eval_stats

# Compared metrics in display order and whether lower is better
# (None = no better/worse mark).
DELTA_METRICS = [
    ("calls", None), ("avg_cost_usd", True), ("total_cost_usd", True),
    ("avg_latency_ms", True), ("latency_p99", True), ("error_rate", True),
    ("avg_input_tokens", None), ("avg_output_tokens", None),
]
# Metrics a rule may test and the comparison operators.
RULE_METRICS = ["latency_p99", "error_rate", "error_count", "avg_cost_usd", "total_calls"]
RULE_OPS = ["<", "<=", ">", ">=", "=", "=="]
F64_EPSILON = sys.float_info.epsilon


def delta_pct(a: Column, b: Column) -> Column:
    """'n/a' when a is 0, '~' under half a percent, else a signed whole percent."""
    d = (b - a) / a * 100.0
    return (F.when(a == 0, F.lit("n/a")).when(F.abs(d) < 0.5, F.lit("~"))
            .otherwise(F.format_string("%+.0f%%", d)))


def model_delta(df: DataFrame, model_a: str, model_b: str, since=None, until=None) -> DataFrame:
    """One row per metric with both values, delta text and better/worse mark.

    The two comparison rows are unpivoted and pivoted back by metric in one
    aggregate (no self-join).
    """
    cmp = compare_models(df, model_a, model_b, since, until)
    pairs = ", ".join(f"'{m}', {i}, CAST({m} AS DOUBLE)" for i, (m, _) in enumerate(DELTA_METRICS))
    long = cmp.select("side", F.expr(f"stack({len(DELTA_METRICS)}, {pairs}) AS (metric, pos, v)"))
    wide = long.groupBy("metric", "pos").agg(
        F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    lower = F.create_map(*[x for m, lb in DELTA_METRICS for x in (F.lit(m), F.lit(lb))])
    lib = F.element_at(lower, F.col("metric"))
    a, b = F.col("a"), F.col("b")
    same = F.abs(b - a) < F.lit(0.001) * F.greatest(F.abs(a), F.lit(1.0))
    better = F.when(lib, b < a).otherwise(b > a)
    mark = F.when(lib.isNull(), F.lit(None).cast("string")).when(same, F.lit("")) \
        .when(better, F.lit("better")).otherwise(F.lit("worse"))
    return wide.select("pos", "metric", "a", "b", delta_pct(a, b).alias("delta_pct"),
                       mark.alias("mark")).orderBy("pos")


def rule_check(df: DataFrame, rules: list[str], f: CallFilter | None = None) -> DataFrame:
    """Evaluate ``METRIC OP VALUE`` rules against eval stats.

    status PASS / FAIL / ERR (bad shape, metric, operator or number).
    ``job_failed`` is true on every row when any rule did not pass.
    """
    spark = df.sparkSession
    stats = eval_stats(df, f)
    metrics = stats.select(F.expr(
        "stack(5, 'latency_p99', CAST(latency_p99 AS DOUBLE), 'error_rate', error_rate, "
        "'error_count', CAST(error_count AS DOUBLE), 'avg_cost_usd', avg_cost_usd, "
        "'total_calls', CAST(total_calls AS DOUBLE)) AS (metric, lhs)"))
    r = spark.createDataFrame([(i, x) for i, x in enumerate(rules)], "pos int, rule string")
    pat = r"^([^ ]*) ([^ ]*) (.*)$"
    t = F.trim(F.col("rule"))
    parsed = r.select("pos", "rule", t.rlike(pat).alias("_shape"),
                      F.regexp_extract(t, pat, 1).alias("metric"),
                      F.regexp_extract(t, pat, 2).alias("op"),
                      F.expr(f"try_cast(regexp_extract(trim(rule), '{pat}', 3) AS DOUBLE)").alias("rhs"))
    j = parsed.join(F.broadcast(metrics), "metric", "left")
    lhs, rhs, op = F.col("lhs"), F.col("rhs"), F.col("op")
    cmp = (F.when(op == "<", lhs < rhs).when(op == "<=", lhs <= rhs).when(op == ">", lhs > rhs)
           .when(op == ">=", lhs >= rhs).when(op.isin("=", "=="), F.abs(lhs - rhs) < F.lit(F64_EPSILON)))
    ok = F.col("_shape") & rhs.isNotNull() & lhs.isNotNull() & op.isin(*RULE_OPS)
    status = F.when(~ok, F.lit("ERR")).when(cmp, F.lit("PASS")).otherwise(F.lit("FAIL"))
    out = j.select("pos", "rule", status.alias("status"), "metric", "op", "lhs", "rhs")
    from pyspark.sql import Window

    failed = F.max((F.col("status") != "PASS").cast("int")).over(Window.partitionBy()) == 1
    return out.withColumn("job_failed", failed).orderBy("pos")


def budget_gate(df: DataFrame, limit_usd: float, f: CallFilter | None = None) -> DataFrame:
    """Report total vs threshold with a fail flag (total > limit)."""
    rep = cost_report(df, f, fail_over_usd=limit_usd)
    return rep.where(F.col("is_total")).select(
        F.col("cost_usd").alias("total_cost_usd"), F.col("calls").alias("total_calls"),
        F.lit(float(limit_usd)).alias("limit_usd"), F.col("over_budget").alias("failed"))
