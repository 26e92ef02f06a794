"""Registered ingest queries: raw exchanges -> calls (A3, B17, H1-H20) and prompt analytics.

The input is the exchange stand-in built from ``conversations``; each
query runs one stage of the enrichment job over all of it. Most keys have
a differential DuckDB oracle (``exchange_oracle.py``): DuckDB rebuilds the
same logical exchanges with its own JSON construction and parses them with
its own functions. The composite stages (size limits, full pipeline, store
round-trip) are row-checked and covered by golden-vector unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import jsonx as J
from callscope.operators import enrich as en
from callscope.operators.filters import llm_only
from callscope.operators import prompts as pm
from callscope.plans.catalog import register
from callscope.plans.exchange_oracle import jint, model_sql, stream_sql, with_ex, with_sse
from callscope.session import scratch_dir
from callscope.sources.exchanges import exchanges_view, load_exchanges
from callscope.sources.store import append_calls, load_calls

ROUTES = [("/v1/messages", "https://api.anthropic.com")]
REDACT = ["messages"]


def _ex(spark, sf):
    return exchanges_view(spark, sf)


def enriched(spark, sf, **kw):
    return en.enrich_calls(_ex(spark, sf), en.EnrichOptions(**kw))


def stored_calls(spark, sf):
    """Ingest (enrich + append to a fresh store on shared storage), then read the calls table."""
    path = scratch_dir(spark, "calls-store")
    append_calls(enriched(spark, sf), path)
    return load_calls(spark, path)


@register("raw_exchanges")
def q_raw_exchanges(spark, sf):
    """A3: the exchange log written to shared storage and read back with the fixed schema."""
    path = scratch_dir(spark, "exchanges")
    _ex(spark, sf).write.mode("overwrite").parquet(path)
    return load_exchanges(spark, path)


@register("request_info", with_ex(f"SELECT exchange_id, {model_sql()} AS model, {stream_sql()} AS is_stream FROM ex"),
          calls_cte=False)
def q_request_info(spark, sf):
    """H1: model (strict string, else 'unknown') and stream flag (strict boolean) per exchange."""
    return en.request_info(_ex(spark, sf))


@register("llm_only", with_ex(f"""SELECT exchange_id, {model_sql()} AS model FROM ex
  WHERE {model_sql()} <> 'unknown' OR coalesce(octet_length(encode(request_body)), 0) > 0 OR {stream_sql()}"""), calls_cte=False)
def q_llm_only(spark, sf):
    """Exchanges that count as LLM calls (known model, non-empty request body, or a stream)."""
    ex = _ex(spark, sf)
    info = ex.select("exchange_id", en.request_model(F.col("request_body")).alias("model"),
                     en.request_stream(F.col("request_body")).alias("is_stream"), "request_body")
    return llm_only(info).select("exchange_id", "model")


@register("usage_from_body", with_ex(f"""SELECT exchange_id,
  coalesce({jint('response_body', '$.usage.prompt_tokens')}, {jint('response_body', '$.usage.input_tokens')}) AS input_tokens,
  CASE WHEN coalesce({jint('response_body', '$.usage.prompt_tokens')}, {jint('response_body', '$.usage.input_tokens')})
       IS NOT NULL THEN coalesce({jint('response_body', '$.usage.completion_tokens')},
                                 {jint('response_body', '$.usage.output_tokens')}, 0) END AS output_tokens
  FROM ex WHERE response_body IS NOT NULL"""), calls_cte=False)
def q_usage_from_body(spark, sf):
    """H2: token usage parsed from buffered JSON response bodies."""
    ex = _ex(spark, sf).where(F.col("response_body").isNotNull())
    u = en.body_usage(F.col("response_body"))
    return ex.select("exchange_id", u["input_tokens"].alias("input_tokens"), u["output_tokens"].alias("output_tokens"))


@register("sse_events")
def q_sse_events(spark, sf):
    """H3: one row per parsed server-sent event of every streamed response."""
    return en.sse_event_rows(_ex(spark, sf))


def _last(expr_list: str) -> str:
    return f"list_filter(flatten({expr_list}), lambda x: x IS NOT NULL)[-1]"


_SSE_IN = _last("list_transform(datas, lambda d: [coalesce(" + jint("d", "$.usage.prompt_tokens") + ", "
                + jint("d", "$.usage.input_tokens") + "), " + jint("d", "$.message.usage.input_tokens") + "])")
_SSE_OUT = _last("list_transform(datas, lambda d: [coalesce(" + jint("d", "$.usage.completion_tokens") + ", "
                 + jint("d", "$.usage.output_tokens") + "), " + jint("d", "$.message.usage.output_tokens") + "])")


@register("usage_from_sse", with_sse(f"""SELECT exchange_id, {_SSE_IN} AS input_tokens,
  CASE WHEN {_SSE_IN} IS NOT NULL THEN coalesce({_SSE_OUT}, 0) END AS output_tokens FROM sse"""), calls_cte=False)
def q_usage_from_sse(spark, sf):
    """H4: token usage reconstructed from the event stream (last non-NULL values)."""
    ex = _ex(spark, sf).where(F.col("chunks").isNotNull())
    u = en.sse_usage(en.sse_events(F.col("chunks")))
    return ex.select("exchange_id", u["input_tokens"].alias("input_tokens"), u["output_tokens"].alias("output_tokens"))


_SSE_TEXT = """array_to_string(list_transform(datas, lambda d:
    coalesce(try(json_extract_string(d, '$.choices[0].delta.content')), '')
    || coalesce(try(json_extract_string(d, '$.delta.text')), '')), '')"""
_TOOL_NAME = """list_filter(list_transform(datas, lambda d: coalesce(
    try(json_extract_string(d, '$.choices[0].delta.tool_calls[0].function.name')),
    try(json_extract_string(d, '$.content_block.name')))), lambda x: x IS NOT NULL AND x <> '')[1]"""
_TOOL_ARGS = """array_to_string(list_filter(list_transform(datas, lambda d: coalesce(
    try(json_extract_string(d, '$.choices[0].delta.tool_calls[0].function.arguments')),
    try(json_extract_string(d, '$.delta.partial_json')))), lambda x: x IS NOT NULL), '')"""


@register("text_from_sse", with_sse(f"""SELECT exchange_id,
  CASE WHEN length({_SSE_TEXT}) > 0 THEN {_SSE_TEXT}
       WHEN {_TOOL_NAME} IS NOT NULL THEN '[{{"arguments":' || json({_TOOL_ARGS})::VARCHAR || ',"name":"'
            || {_TOOL_NAME} || '"}}]'
       ELSE '' END AS text FROM sse"""), calls_cte=False)
def q_text_from_sse(spark, sf):
    """H5: response text (or tool-call summary) assembled from the event stream."""
    ex = _ex(spark, sf).where(F.col("chunks").isNotNull())
    ev = ex.select("exchange_id", en.sse_events(F.col("chunks")).alias("_events"))
    return en.with_sse_text(ev, "_events", "text").select("exchange_id", "text")


_SYS = """coalesce(CASE WHEN try(json_type(request_body, '$.system')) = 'VARCHAR'
      THEN try(json_extract_string(request_body, '$.system')) END,
  try(json_extract_string(list_filter(try(json_extract(request_body, '$.messages[*]')),
      lambda m: json_extract_string(m, '$.role') = 'system')[1], '$.content')))"""


@register("system_prompt", with_ex(f"""SELECT exchange_id,
  CASE WHEN length(regexp_replace({_SYS}, '^\\s+|\\s+$', '', 'g')) > 0
       THEN regexp_replace({_SYS}, '^\\s+|\\s+$', '', 'g') END AS system_prompt FROM ex"""), calls_cte=False)
def q_system_prompt(spark, sf):
    """H6: system prompt of every request (``system`` field or first system message)."""
    return _ex(spark, sf).select("exchange_id", J.system_prompt(F.col("request_body")).alias("system_prompt"))


def _fnv_sql(s: str) -> str:
    """DuckDB FNV-1a-64 of the UTF-8 bytes of ``s`` (HUGEINT arithmetic), 16 hex digits."""
    return (f"lower(lpad(hex(CAST(list_reduce(list_transform(range(0, octet_length(encode({s}))), "
            f"lambda i: CAST(('0x' || substr(hex(encode({s})), CAST(2*i+1 AS BIGINT), 2)) AS INTEGER)::HUGEINT), "
            f"lambda acc, b: (xor(acc, b) * CAST(1099511628211 AS HUGEINT)) % CAST('18446744073709551616' AS HUGEINT), "
            f"CAST('14695981039346656037' AS HUGEINT)) AS UBIGINT)), 16, '0'))")


_TRIMMED = f"regexp_replace({_SYS}, '^\\s+|\\s+$', '', 'g')"


@register("prompt_hash", with_ex(f"""SELECT exchange_id, CASE WHEN length({_TRIMMED}) > 0 THEN {_fnv_sql(_TRIMMED)} END
  AS prompt_hash FROM ex"""), calls_cte=False)
def q_prompt_hash(spark, sf):
    """H7: FNV-1a 64 fingerprint of each request's system prompt."""
    return _ex(spark, sf).select("exchange_id", J.prompt_hash(F.col("request_body")).alias("prompt_hash"))


def _redacted_sql() -> str:
    """Expected redacted request text: sorted keys, ``messages`` replaced (system key only when set)."""
    model_kv = ("CASE WHEN conv_id % 17 = 5 THEN NULL WHEN conv_id % 19 = 7 THEN '42' "
                "ELSE to_json(model_name)::VARCHAR END")
    return f"""SELECT exchange_id, CASE WHEN non_llm THEN '' ELSE
      '{{' || array_to_string(list_filter([
        CASE WHEN anthropic THEN '"max_tokens":1024' END,
        '"messages":"[REDACTED]"',
        CASE WHEN {model_kv} IS NOT NULL THEN '"model":' || {model_kv} END,
        '"stream":' || CASE WHEN stream THEN 'true' ELSE 'false' END,
        CASE WHEN anthropic AND sys_text IS NOT NULL THEN '"system":' || to_json(sys_text)::VARCHAR END],
        lambda x: x IS NOT NULL), ',') || '}}' END AS request_body
      FROM ex JOIN (SELECT lpad(CAST(conv_id AS VARCHAR), 6, '0') || '-' || lpad(CAST(turn AS VARCHAR), 3, '0') AS xid,
                           model_name, sys_text FROM ex2) m ON m.xid = ex.exchange_id"""


@register("redact", with_ex(_redacted_sql()), calls_cte=False)
def q_redact(spark, sf):
    """H9: request bodies with the ``messages`` field redacted."""
    return _ex(spark, sf).select("exchange_id", J.redact(F.col("request_body"), REDACT).alias("request_body"))


@register("suppress_body", with_ex(f"""SELECT exchange_id AS id, CAST(NULL AS VARCHAR) AS request_body,
  CAST(NULL AS VARCHAR) AS prompt_hash FROM ex
  WHERE {model_sql()} <> 'unknown' OR coalesce(octet_length(encode(request_body)), 0) > 0
     OR (NOT failed AND CASE WHEN h_content_type IS NOT NULL THEN contains(h_content_type, 'text/event-stream')
                             ELSE {stream_sql()} END)"""), calls_cte=False)
def q_suppress_body(spark, sf):
    """Calls captured with request-body storage switched off."""
    return enriched(spark, sf, store_request_bodies=False).select("id", "request_body", "prompt_hash")


@register("body_limits")
def q_body_limits(spark, sf):
    """Enrichment under small size limits (markers for oversized bodies and streams)."""
    lim = en.Limits(max_request=4000, max_stored_response=600, max_accumulation=700, max_stored_stream=300)
    return enriched(spark, sf, limits=lim).select("id", "input_tokens", "output_tokens", "response_body")


@register("trace_context", with_ex("""SELECT exchange_id,
  CASE WHEN len(string_split(h_traceparent, '-')) = 4 THEN string_split(h_traceparent, '-')[2]
       ELSE coalesce(h_trace_id, h_b3_trace) END AS trace_id,
  CASE WHEN len(string_split(h_traceparent, '-')) = 4 THEN string_split(h_traceparent, '-')[3]
       ELSE h_parent_span END AS parent_id FROM ex"""), calls_cte=False)
def q_trace_context(spark, sf):
    """Trace and parent ids from traceparent / trace headers."""
    t = en.trace_ids()
    return _ex(spark, sf).select("exchange_id", t["trace_id"].alias("trace_id"), t["parent_id"].alias("parent_id"))


@register("orchestration", with_ex("""SELECT exchange_id, h_tag AS tags, h_agent AS agent_name,
  h_workflow AS workflow_id, h_span AS span_name FROM ex"""), calls_cte=False)
def q_orchestration(spark, sf):
    """Tag, agent, workflow and span from orchestration headers."""
    return _ex(spark, sf).select(
        "exchange_id", en.header("request_headers", "x-trace-tag").alias("tags"),
        en.header("request_headers", "x-trace-agent").alias("agent_name"),
        en.header("request_headers", "x-trace-workflow").alias("workflow_id"),
        en.header("request_headers", "x-trace-span").alias("span_name"))


@register("endpoint_path", with_ex("""SELECT exchange_id, path, split_part(path, '?', 1) AS endpoint FROM ex"""),
          calls_cte=False)
def q_endpoint_path(spark, sf):
    """Request path without query string."""
    return _ex(spark, sf).select("exchange_id", "path", en.endpoint_path(F.col("path")).alias("endpoint"))


@register("is_sse", with_ex(f"""SELECT exchange_id, CASE WHEN h_content_type IS NOT NULL
  THEN contains(h_content_type, 'text/event-stream') ELSE {stream_sql()} END AS is_sse FROM ex"""), calls_cte=False)
def q_is_sse(spark, sf):
    """Streaming decided by response content-type, else the request flag."""
    return _ex(spark, sf).select("exchange_id", en.is_sse(en.request_stream(F.col("request_body"))).alias("is_sse"))


@register("ttft")
def q_ttft(spark, sf):
    """Time to first token (first non-empty chunk, else latency; NULL on failure)."""
    return enriched(spark, sf).select("id", "latency_ms", "ttft_ms")



_PRICE_IN = ("CASE {m} WHEN 'gpt-4o' THEN 2.5 WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'claude-3-5-sonnet-20241022' THEN 3.0 "
             "WHEN 'gemini-2.5-pro' THEN 1.25 WHEN 'llama-3.1-70b' THEN 0.52 ELSE 1.0 END::DOUBLE")
_PRICE_OUT = ("CASE {m} WHEN 'gpt-4o' THEN 10.0 WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'claude-3-5-sonnet-20241022' THEN 15.0 "
              "WHEN 'gemini-2.5-pro' THEN 10.0 WHEN 'llama-3.1-70b' THEN 0.75 ELSE 3.0 END::DOUBLE")


def _cost_sql(m: str) -> str:
    """Cache-aware cost over columns i, o, w, r, c (DuckDB)."""
    pin, pout = _PRICE_IN.format(m=m), _PRICE_OUT.format(m=m)
    return f"""CASE WHEN i IS NULL THEN NULL WHEN i < 0 OR o < 0 THEN 0.0::DOUBLE
      WHEN w > 0 OR r > 0 THEN (CAST(greatest(i - w - r, 0) AS DOUBLE) * {pin} + CAST(w AS DOUBLE) * {pin} * 1.25::DOUBLE
                                + CAST(r AS DOUBLE) * {pin} * 0.10::DOUBLE + CAST(o AS DOUBLE) * {pout}) / 1e6
      WHEN c > 0 THEN (CAST(greatest(i - c, 0) AS DOUBLE) * {pin} + CAST(c AS DOUBLE) * {pin} * 0.50::DOUBLE
                       + CAST(o AS DOUBLE) * {pout}) / 1e6
      ELSE (CAST(i AS DOUBLE) * {pin} + CAST(o AS DOUBLE) * {pout}) / 1e6 END"""


_BODY_IN = f"coalesce({jint('response_body', '$.usage.prompt_tokens')}, {jint('response_body', '$.usage.input_tokens')})"
_BODY_OUT = (f"coalesce({jint('response_body', '$.usage.completion_tokens')}, "
             f"{jint('response_body', '$.usage.output_tokens')}, 0)")


def _last_pos(paths: list[str]) -> str:
    inner = ", ".join(jint("d", p) for p in paths)
    return f"coalesce(list_filter(flatten(list_transform(datas, lambda d: [{inner}])), lambda x: x > 0)[-1], 0)"


@register("cost_body", with_ex(f"""SELECT id, model, i AS input_tokens, o AS output_tokens, {_cost_sql('model')} AS cost_usd
  FROM (SELECT exchange_id AS id, {model_sql()} AS model, {_BODY_IN} AS i,
          CASE WHEN {_BODY_IN} IS NOT NULL THEN {_BODY_OUT} END AS o,
          coalesce({jint('response_body', '$.usage.cache_creation_input_tokens')}, 0) AS w,
          coalesce({jint('response_body', '$.usage.cache_read_input_tokens')}, 0) AS r,
          coalesce({jint('response_body', '$.usage.prompt_tokens_details.cached_tokens')}, 0) AS c
        FROM ex WHERE NOT (stream AND NOT failed AND NOT non_llm)
          AND ({model_sql()} <> 'unknown' OR coalesce(octet_length(encode(request_body)), 0) > 0))"""),
          calls_cte=False, raw=True)
def q_cost_body(spark, sf):
    """Cache-aware cost of buffered responses."""
    ex = _ex(spark, sf).where(F.col("chunks").isNull())
    return en.enrich_calls(ex).select("id", "model", "input_tokens", "output_tokens", "cost_usd")


@register("cost_sse", with_sse(f"""SELECT id, model, i AS input_tokens, o AS output_tokens, {_cost_sql('model')} AS cost_usd
  FROM (SELECT s.exchange_id AS id, {model_sql('e.request_body')} AS model, {_SSE_IN} AS i,
          CASE WHEN {_SSE_IN} IS NOT NULL THEN coalesce({_SSE_OUT}, 0) END AS o,
          {_last_pos(['$.message.usage.cache_creation_input_tokens', '$.usage.cache_creation_input_tokens'])} AS w,
          {_last_pos(['$.message.usage.cache_read_input_tokens', '$.usage.cache_read_input_tokens'])} AS r,
          {_last_pos(['$.usage.prompt_tokens_details.cached_tokens'])} AS c
        FROM sse s JOIN ex e ON e.exchange_id = s.exchange_id)"""), calls_cte=False, raw=True)
def q_cost_sse(spark, sf):
    """Cache-aware cost of streamed responses (last positive cache counts)."""
    ex = _ex(spark, sf).where(F.col("chunks").isNotNull())
    return en.enrich_calls(ex).select("id", "model", "input_tokens", "output_tokens", "cost_usd")


@register("enrich_calls")
def q_enrich_calls(spark, sf):
    """The full capture pipeline (routes, redaction, pricing) -> calls."""
    return enriched(spark, sf, routes=ROUTES, redact_fields=[], overrides={"mystery": (0.5, 1.5)})


_HASHED = f"""SELECT exchange_id AS id,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 10 AS BIGINT)) + to_seconds(CAST(turn * 7 AS BIGINT)) AS call_ts,
      request_body, CASE WHEN length({_TRIMMED}) > 0 THEN {_fnv_sql(_TRIMMED)} END AS prompt_hash,
      CASE WHEN length({_TRIMMED}) > 0 THEN {_TRIMMED} END AS prompt
    FROM ex WHERE {model_sql()} <> 'unknown' OR coalesce(octet_length(encode(request_body)), 0) > 0
       OR (NOT failed AND CASE WHEN h_content_type IS NOT NULL THEN contains(h_content_type, 'text/event-stream')
                               ELSE {stream_sql()} END)"""


@register("prompt_sample", with_ex(f"""SELECT prompt_hash, arg_min(request_body, (call_ts, id)) AS request_body
  FROM ({_HASHED}) WHERE prompt_hash IS NOT NULL AND request_body IS NOT NULL GROUP BY prompt_hash"""),
          calls_cte=False)
def q_prompt_sample(spark, sf):
    """One deterministic sample request body per prompt hash."""
    return pm.prompt_sample(stored_calls(spark, sf))


@register("prompt_list")
def q_prompt_list(spark, sf):
    """Prompt fingerprints with usage stats and previews."""
    return pm.prompt_list(stored_calls(spark, sf), since="2024-01-01")


@register("prompt_text", with_ex(f"""SELECT prompt_hash, arg_min(prompt, (call_ts, id)) AS prompt FROM ({_HASHED})
  WHERE prompt_hash = (SELECT prompt_hash FROM ({_HASHED}) WHERE prompt_hash IS NOT NULL
                       GROUP BY prompt_hash ORDER BY count(*) DESC, prompt_hash LIMIT 1)
    AND request_body IS NOT NULL GROUP BY prompt_hash"""), calls_cte=False)
def q_prompt_text(spark, sf):
    """H8: full system prompt of the most used fingerprint."""
    calls = stored_calls(spark, sf)
    top = pm.prompt_list(calls).limit(1).select("hash")
    # join the single chosen hash back (one row; broadcast)
    sample = pm.prompt_sample(calls).join(F.broadcast(top), F.col("prompt_hash") == F.col("hash"))
    return sample.select("prompt_hash", J.system_prompt(F.col("request_body")).alias("prompt"))
