"""Physical-plan checks: pushdown, pruning, broadcast and shuffle shape."""

from pyspark.sql import functions as F

from callscope.functions.predicates import CallFilter
from callscope.operators import aggregates as ag
from callscope.operators import filters as fl
from callscope.operators import pricing as pr
from callscope.session import scratch_dir
from callscope.sources.fixtures import calls_view
from callscope.sources.store import append_calls, load_calls

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def _store(spark):
    path = scratch_dir(spark, "t-plan-store")
    append_calls(calls_view(spark, SF), path)
    return load_calls(spark, path, with_partition=True)


def test_time_filter_prunes_partitions_and_pushes_down(spark):
    df = _store(spark)
    q = fl.list_calls(df, CallFilter(since="2024-01-05", until="2024-01-06", model="gpt"), 10)
    p = _plan(q)
    assert "PartitionFilters: [isnotnull(call_date" in p and "call_date#" in p
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(call_ts" in pushed and "LessThanOrEqual(call_ts" in pushed
    assert "TakeOrderedAndProject" in p


def test_aggregate_prunes_columns(spark):
    df = _store(spark)
    p = _plan(ag.stats_by_model(df))
    assert "request_body" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_daily_stats_prunes_days(spark):
    p = _plan(ag.daily_stats(_store(spark), days=3, as_of="2024-01-31T00:00:00"))
    assert "PartitionFilters: [isnotnull(call_date" in p


def test_pricing_is_an_expression(spark):
    df = _store(spark).drop("cost_usd").withColumn("cost_usd", F.lit(None).cast("double"))
    p = _plan(pr.with_simple_cost(df))
    assert "Join" not in p and "Exchange" not in p
