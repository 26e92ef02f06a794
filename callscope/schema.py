"""Schemas of the fact table, the raw exchange log and the dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

# The one fact table. Column order is the canonical output order.
CALLS = T.StructType([
    T.StructField("id", S, False),
    T.StructField("call_ts", TS, False),
    T.StructField("provider", S),
    T.StructField("model", S),
    T.StructField("endpoint", S),
    T.StructField("status_code", I),
    T.StructField("latency_ms", L),
    T.StructField("ttft_ms", L),
    T.StructField("input_tokens", L),
    T.StructField("output_tokens", L),
    T.StructField("cost_usd", D),
    T.StructField("request_body", S),
    T.StructField("response_body", S),
    T.StructField("error", S),
    T.StructField("provider_request_id", S),
    T.StructField("trace_id", S),
    T.StructField("parent_id", S),
    T.StructField("prompt_hash", S),
    T.StructField("tags", S),
    T.StructField("agent_name", S),
    T.StructField("workflow_id", S),
    T.StructField("span_name", S),
])
CALL_COLUMNS = [f.name for f in CALLS.fields]
BODY_COLUMNS = ["request_body", "response_body"]

# One raw request/response exchange as seen on the wire.
CHUNK = T.StructType([T.StructField("offset_ms", L), T.StructField("data", S)])
EXCHANGES = T.StructType([
    T.StructField("exchange_id", S, False),
    T.StructField("started_at", TS),
    T.StructField("method", S),
    T.StructField("path", S),
    T.StructField("upstream", S),
    T.StructField("request_headers", T.MapType(S, S)),
    T.StructField("request_body", S),
    T.StructField("status_code", I),
    T.StructField("response_headers", T.MapType(S, S)),
    T.StructField("response_body", S),
    T.StructField("chunks", T.ArrayType(CHUNK)),
    T.StructField("latency_ms", L),
    T.StructField("transport_error", S),
])

PRICES = T.StructType([
    T.StructField("rank", I, False),
    T.StructField("pattern", S),
    T.StructField("all_of", T.ArrayType(S)),
    T.StructField("any_of", T.ArrayType(S)),
    T.StructField("input_per_mtok", D),
    T.StructField("output_per_mtok", D),
])
OVERRIDES = T.StructType([
    T.StructField("pattern", S, False),
    T.StructField("input_per_mtok", D),
    T.StructField("output_per_mtok", D),
])
ROUTES = T.StructType([
    T.StructField("rank", I, False),
    T.StructField("path", S),
    T.StructField("upstream", S),
])
PROVIDERS = T.StructType([
    T.StructField("rank", I, False),
    T.StructField("all_of", T.ArrayType(S)),
    T.StructField("any_of", T.ArrayType(S)),
    T.StructField("provider", S),
])
META = T.StructType([
    T.StructField("key", S, False),
    T.StructField("value", S),
    T.StructField("updated_at", TS),
])
