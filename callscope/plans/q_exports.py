"""Registered export queries (A5-A13, A15) over the calls view."""

from __future__ import annotations

from callscope.functions.predicates import CallFilter
from callscope.operators.aggregates import cost_report
from callscope.plans.catalog import calls, register
from callscope.plans.q_enrich import stored_calls
from callscope.sources import exports as ex


@register("export_jsonl")
def q_export_jsonl(spark, sf):
    """A5: one JSON line per call with all fields."""
    return ex.jsonl(calls(spark, sf))


@register("export_csv", """SELECT id, strftime(call_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
  coalesce(provider, '') AS provider, coalesce(model, '') AS model, coalesce(endpoint, '') AS endpoint,
  coalesce(CAST(status_code AS VARCHAR), '') AS status_code, coalesce(CAST(latency_ms AS VARCHAR), '') AS latency_ms,
  coalesce(CAST(ttft_ms AS VARCHAR), '') AS ttft_ms, coalesce(CAST(input_tokens AS VARCHAR), '') AS input_tokens,
  coalesce(CAST(output_tokens AS VARCHAR), '') AS output_tokens, coalesce(printf('%.8f', cost_usd), '') AS cost_usd,
  coalesce(error, '') AS error, coalesce(provider_request_id, '') AS provider_request_id FROM calls""", raw=True)
def q_export_csv(spark, sf):
    """The 13 CSV fields per call (8-decimal cost, NULL as empty)."""
    return ex.csv_fields(calls(spark, sf)).drop("_ts")


_CSV_COLS = ["id", "timestamp", "provider", "model", "endpoint", "status_code", "latency_ms", "ttft_ms",
             "input_tokens", "output_tokens", "cost_usd", "error", "provider_request_id"]
_Q = "CASE WHEN regexp_matches({c}, '[,\"\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@register("export_csv_lines", f"""SELECT id, call_ts, concat_ws(',', {', '.join(_Q.format(c=c) for c in _CSV_COLS)}) AS line
  FROM (SELECT call_ts, id, strftime(call_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
  coalesce(provider, '') AS provider, coalesce(model, '') AS model, coalesce(endpoint, '') AS endpoint,
  coalesce(CAST(status_code AS VARCHAR), '') AS status_code, coalesce(CAST(latency_ms AS VARCHAR), '') AS latency_ms,
  coalesce(CAST(ttft_ms AS VARCHAR), '') AS ttft_ms, coalesce(CAST(input_tokens AS VARCHAR), '') AS input_tokens,
  coalesce(CAST(output_tokens AS VARCHAR), '') AS output_tokens, coalesce(printf('%.8f', cost_usd), '') AS cost_usd,
  coalesce(error, '') AS error, coalesce(provider_request_id, '') AS provider_request_id FROM calls)""", raw=True)
def q_export_csv_lines(spark, sf):
    """CSV lines with minimal quoting (error texts with commas/quotes are quoted)."""
    return ex.csv_lines(calls(spark, sf))


@register("export_csv_all_quoted")
def q_export_csv_all_quoted(spark, sf):
    """All calls, every field quoted."""
    return ex.csv_all_quoted(calls(spark, sf))


@register("export_langfuse")
def q_export_langfuse(spark, sf):
    """Langfuse-style ingestion events for captured calls with bodies."""
    return ex.langfuse(stored_calls(spark, sf))


@register("export_langsmith")
def q_export_langsmith(spark, sf):
    """LangSmith-style run objects."""
    return ex.langsmith(stored_calls(spark, sf))


@register("export_weave")
def q_export_weave(spark, sf):
    """A10: Weave-style upsert batches with per-model usage."""
    return ex.weave(stored_calls(spark, sf))


@register("export_otlp")
def q_export_otlp(spark, sf):
    """OTLP/JSON spans for every call."""
    return ex.otlp_spans(calls(spark, sf))


@register("export_phoenix")
def q_export_phoenix(spark, sf):
    """OpenInference spans with input/output values."""
    return ex.phoenix_spans(stored_calls(spark, sf))


@register("export_metadata_only")
def q_export_metadata_only(spark, sf):
    """Langfuse events with bodies removed."""
    return ex.langfuse(ex.without_bodies(stored_calls(spark, sf)))


@register("cost_report_render", """WITH m AS (SELECT model, count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS i,
    CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS o, coalesce(sum(cost_usd), 0.0) AS c
    FROM calls WHERE call_ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY model)
  SELECT 0 AS seq, '| Model | Calls | Input | Output | Cost (USD) |' AS line
  UNION ALL SELECT 1, '|---|---:|---:|---:|---:|'
  UNION ALL SELECT CAST(row_number() OVER (ORDER BY c DESC, model) + 1 AS INTEGER),
    printf('| %s | %d | %d | %d | $%.4f |', model, calls, i, o, c) FROM m
  UNION ALL SELECT 1073741824, printf('| **Total** | %d | | | $%.4f |', sum(calls), sum(c)) FROM m""")
def q_cost_report_render(spark, sf):
    """The cost report rendered as a markdown table (ordered lines)."""
    rep = cost_report(calls(spark, sf), CallFilter(since="2024-01-05"))
    return ex.report_lines(rep, "markdown")


@register("cost_report_json")
def q_cost_report_json(spark, sf):
    """The cost report as one JSON document."""
    rep = cost_report(calls(spark, sf), CallFilter())
    return ex.report_json(rep)

