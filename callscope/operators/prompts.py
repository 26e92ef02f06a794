"""Prompt fingerprint analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.jsonx import system_prompt
from callscope.functions.predicates import by_model, with_time_window

PREVIEW_CHARS = 80


def prompt_sample(df: DataFrame) -> DataFrame:
    """One sample request body per prompt hash over *all* calls.

    The reference takes an arbitrary body in a correlated subquery; here it
    is decorrelated into a partial/final aggregate with a deterministic
    choice: the body of the earliest call (ties by id).
    """
    return (df.where(F.col("prompt_hash").isNotNull() & F.col("request_body").isNotNull())
            .groupBy("prompt_hash")
            .agg(F.min_by("request_body", F.struct("call_ts", "id")).alias("request_body")))


def prompt_list(df: DataFrame, since=None, model: str | None = None) -> DataFrame:
    """Per prompt hash: calls, average cost and latency, first/last seen, 80-char preview.

    Filters (since, model substring) apply to the counted calls; the sample
    body for the preview comes from all calls, as in C15.
    """
    base = df.where(F.col("prompt_hash").isNotNull())
    if since is not None:
        base = with_time_window(base, since=since)
    if model is not None:
        base = base.where(by_model(model))
    stats = base.groupBy("prompt_hash").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("avg_cost_usd"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.min("call_ts").alias("first_seen"), F.max("call_ts").alias("last_seen"))
    sample = prompt_sample(df)
    preview = F.substring(F.coalesce(system_prompt(F.col("request_body")), F.lit("")), 1, PREVIEW_CHARS)
    return (stats.join(sample, "prompt_hash", "left")
            .select(F.col("prompt_hash").alias("hash"), "call_count", "avg_cost_usd", "avg_latency_ms",
                    "first_seen", "last_seen", preview.alias("preview"))
            .orderBy(F.col("call_count").desc(), "hash"))


def prompt_text(df: DataFrame, prompt_hash: str) -> DataFrame:
    """H8: the full system prompt for one hash (one row; NULL when unknown or unparsable)."""
    spark = df.sparkSession
    key = spark.createDataFrame([(prompt_hash,)], "prompt_hash string")
    sample = prompt_sample(df.where(F.col("prompt_hash") == prompt_hash))
    return (key.join(sample, "prompt_hash", "left")
            .select("prompt_hash", system_prompt(F.col("request_body")).alias("prompt")))
