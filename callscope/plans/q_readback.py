"""Exports and feeds read back: each line is parsed again and compared with the calls.

The input adds bodies to the calls view, so that payload rules (whole
bodies, JSON null for a missing one, absent agent and workflow) are reached.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import enrich as en
from callscope.operators import prompts as pm
from callscope.plans.catalog import AS_OF, calls, register
from callscope.plans.exchange_oracle import model_sql, stream_sql, with_ex, with_sse
from callscope.plans.q_enrich import _HASHED, _SSE_TEXT, _TOOL_ARGS, _TOOL_NAME, _ex, enriched, stored_calls
from callscope.plans.q_streaming import _dirs, _stream, exchange_log
from callscope.session import scratch_dir
from callscope.sources import exports as ex
from callscope.sources.exchanges import load_exchanges
from callscope.sources.store import load_calls
from callscope.streaming import live as lv

_TS = "strftime(call_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_END = "regexp_replace(strftime(call_ts + to_milliseconds(coalesce(latency_ms, 0)), '%Y-%m-%dT%H:%M:%S.%g'), '[.]000$', '') || '+00:00'"
_PLAIN = ["provider", "model", "endpoint", "status_code", "latency_ms", "ttft_ms", "input_tokens", "output_tokens", "cost_usd", "error", "trace_id",
          "parent_id", "tags", "agent_name", "workflow_id", "span_name"]
_LINE = ("id string, timestamp string, provider string, model string, endpoint string, status_code int, latency_ms long, ttft_ms long, input_tokens long, "
         "output_tokens long, cost_usd double, error string, trace_id string, parent_id string, tags string, agent_name string, workflow_id string, span_name string")


def _with_bodies(df):
    """Calls with a JSON request, and a response unless they failed."""
    body = F.concat(F.lit('{"m":"'), "model", F.lit('","pad":"'), F.repeat(F.lit("x"), 11_000), F.lit('"}'))
    return df.withColumn("request_body", body).withColumn("response_body", F.when(F.col("error").isNull(), F.concat(F.lit('{"n":'), F.col("latency_ms").cast("string"), F.lit("}"))))


def _get(path: str):
    return F.get_json_object("line", path)


@register("export_jsonl_parsed", f"SELECT id, {_TS} AS timestamp, {', '.join(_PLAIN)} FROM calls", raw=True)
def q_export_jsonl_parsed(spark, sf):
    """A5: JSON lines of all calls, parsed back."""
    return ex.jsonl(calls(spark, sf)).select(F.from_json("line", _LINE).alias("r")).select("r.*")


@register("change_feed_parsed", f"SELECT id, {_TS} AS timestamp, {', '.join(_PLAIN)} FROM calls", raw=True)
def q_change_feed_parsed(spark, sf):
    """The change feed's event lines, parsed back: every arriving call once."""
    out, ck = _dirs(spark, "feed-parsed")
    lv.change_feed(_stream(spark, sf), out, ck, available_now=True).awaitTermination()
    return spark.read.text(out).select(F.from_json("value", _LINE).alias("r")).select("r.*")


@register("export_csv_all_quoted_parsed", f"""SELECT id, {_TS} AS timestamp, provider, model, endpoint, CAST(status_code AS INT) AS status_code, latency_ms,
  nullif(ttft_ms, 0) AS ttft_ms, nullif(input_tokens, 0) AS input_tokens, nullif(output_tokens, 0) AS output_tokens, nullif(cost_usd, 0) AS cost_usd,
  nullif(error, '') AS error FROM calls""", raw=True)
def q_export_csv_all_quoted_parsed(spark, sf):
    """The all-quoted CSV lines of all calls, parsed back."""
    names = ex.ALL_QUOTED_HEADER.split(",")
    parsed = ex.csv_all_quoted(calls(spark, sf)).select(F.from_csv("line", ", ".join(f"{n} string" for n in names), {"escape": '"'}).alias("r"))
    kinds = {"status_code": "int", "latency_ms": "long", "ttft_ms": "long", "input_tokens": "long", "output_tokens": "long", "cost_usd": "double"}
    return parsed.select(*[F.nullif(F.col(f"r.{n}"), F.lit("")).cast(kinds.get(n, "string")).alias(n) for n in names])


_GENERATION = f"""SELECT id, coalesce(workflow_id, id) AS trace, {_TS} AS started, {_END} AS ended, model, {{inp}} AS input, {{out}} AS output,
  input_tokens AS used_in, output_tokens AS used_out, input_tokens + output_tokens AS used, cost_usd AS cost, agent_name AS agent, workflow_id AS workflow,
  workflow_id IS NOT NULL AS has_workflow, CASE WHEN error IS NULL THEN 'DEFAULT' ELSE 'ERROR' END AS level FROM calls"""


#: What is read back of an ingestion event: numbers as their text, cast afterwards.
_EVENT = ("batch array<struct<body struct<id string, traceId string, startTime string, endTime string, model string, input struct<m string>, output struct<n string>, "
          "usage struct<input string, output string, total string>, metadata struct<cost_usd string, agent_name string, workflow_id string>, level string>>>")


def _generation(df):
    # every line is parsed once for all its fields
    b = F.get("r.batch", F.lit(0))["body"]
    return ex.langfuse(df).select(F.from_json("line", _EVENT).alias("r"), F.col("line").contains('"workflow_id":').alias("has_workflow")).select(
        b["id"].alias("id"), b["traceId"].alias("trace"), b["startTime"].alias("started"), b["endTime"].alias("ended"),
        b["model"].alias("model"), b["input"]["m"].alias("input"), b["output"]["n"].cast("long").alias("output"),
        b["usage"]["input"].cast("long").alias("used_in"), b["usage"]["output"].cast("long").alias("used_out"), b["usage"]["total"].cast("long").alias("used"),
        b["metadata"]["cost_usd"].cast("double").alias("cost"), b["metadata"]["agent_name"].alias("agent"), b["metadata"]["workflow_id"].alias("workflow"),
        "has_workflow", b["level"].alias("level"))


@register("export_langfuse_parsed", _GENERATION.format(inp="model", out="CASE WHEN error IS NULL THEN latency_ms END"), raw=True)
def q_export_langfuse_parsed(spark, sf):
    """Ingestion events of calls with bodies over 10 kB, parsed back."""
    return _generation(_with_bodies(calls(spark, sf)))


@register("export_metadata_only_parsed", _GENERATION.format(inp="CAST(NULL AS VARCHAR)", out="CAST(NULL AS BIGINT)"), raw=True)
def q_export_metadata_only_parsed(spark, sf):
    """The same events without bodies, parsed back."""
    return _generation(ex.without_bodies(_with_bodies(calls(spark, sf))))


@register("export_langsmith_parsed", """SELECT id, 'llm' AS kind, model AS input, epoch_us(call_ts) // 1000 AS started, epoch_us(call_ts) // 1000 + coalesce(latency_ms, 0) AS ended,
  input_tokens AS used_in, cost_usd AS cost, workflow_id AS workflow, workflow_id IS NOT NULL AS has_workflow, error,
  concat_ws(',', 'callscope', provider, agent_name) AS tags FROM calls""", raw=True)
def q_export_langsmith_parsed(spark, sf):
    """Run objects, parsed back."""
    tags = F.array_join(F.from_json(_get("$.tags"), "array<string>"), ",")
    return ex.langsmith(_with_bodies(calls(spark, sf))).select(
        _get("$.id").alias("id"), _get("$.run_type").alias("kind"), _get("$.inputs.messages.m").alias("input"), _get("$.start_time").cast("long").alias("started"),
        _get("$.end_time").cast("long").alias("ended"), _get("$.extra.input_tokens").cast("long").alias("used_in"), _get("$.extra.cost_usd").cast("double").alias("cost"),
        _get("$.extra.workflow_id").alias("workflow"), F.col("line").contains('"workflow_id":').alias("has_workflow"), _get("$.error").alias("error"), tags.alias("tags"))


@register("export_weave_parsed", f"""SELECT id, {_TS} AS started, {_END} AS ended, model AS input, CASE WHEN error IS NULL THEN latency_ms END AS output,
  coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS used, cost_usd AS cost, agent_name AS agent FROM calls""", raw=True)
def q_export_weave_parsed(spark, sf):
    """A10: upsert batches, parsed back (usage is keyed by model)."""
    c = "$.calls[0]."
    usage = F.from_json(_get(c + "summary.usage"), "map<string,struct<total_tokens:bigint>>")
    return ex.weave(_with_bodies(calls(spark, sf))).select(
        _get(c + "id").alias("id"), _get(c + "started_at").alias("started"), _get(c + "ended_at").alias("ended"), _get(c + "inputs.messages.m").alias("input"),
        _get(c + "output.n").cast("long").alias("output"), F.try_element_at(usage, _get(c + "inputs.model"))["total_tokens"].alias("used"),
        _get(c + "attributes.cost_usd").cast("double").alias("cost"), _get(c + "attributes.agent_name").alias("agent"))


_SPAN = ("struct<traceId:string,spanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int,message:string>,"
         "attributes:array<struct<key:string,value:struct<stringValue:string,intValue:bigint,doubleValue:double>>>>")
_IDS = """base64(unhex(substr(sha256('trace:' || id), 1, 32))) AS trace, base64(unhex(substr(sha256('span:' || id), 1, 16))) AS span,
  CAST(epoch_us(call_ts) * 1000 AS VARCHAR) AS started, CAST(epoch_us(call_ts) * 1000 + coalesce(latency_ms, 0) * 1000000 AS VARCHAR) AS ended,
  CASE WHEN error IS NOT NULL OR status_code >= 400 OR status_code = 0 THEN 2 ELSE 1 END AS status"""


def _span(lines, **attributes):
    s = lines.select(F.from_json(F.get_json_object("line", "$.resourceSpans[0].scopeSpans[0].spans[0]"), _SPAN).alias("s")).select("s.*")

    def attr(key, kind):
        return F.try_element_at(F.filter("attributes", lambda a: a["key"] == key), F.lit(1))["value"][kind]
    return s.select(F.col("traceId").alias("trace"), F.col("spanId").alias("span"), F.col("startTimeUnixNano").alias("started"), F.col("endTimeUnixNano").alias("ended"),
                    F.col("status.code").alias("status"), "name", *[attr(*v).alias(k) for k, v in attributes.items()])


@register("export_otlp_parsed", f"""SELECT {_IDS}, coalesce(span_name, CASE WHEN contains(endpoint, 'embedding') THEN 'embeddings' ELSE 'chat' END || ' ' || model) AS name,
  model, input_tokens AS used_in, output_tokens AS used_out, input_tokens + output_tokens AS used, cost_usd AS cost, ttft_ms AS ttft, error, agent_name AS agent FROM calls""", raw=True)
def q_export_otlp_parsed(spark, sf):
    """Span documents, parsed back; ids are digests of the call id."""
    return _span(ex.otlp_spans(calls(spark, sf)), model=("gen_ai.request.model", "stringValue"), used_in=("gen_ai.usage.input_tokens", "intValue"),
                 used_out=("gen_ai.usage.output_tokens", "intValue"), used=("llm.token_count.total", "intValue"), cost=("llm.cost_usd", "doubleValue"),
                 ttft=("llm.ttft_ms", "intValue"), error=("error.type", "stringValue"), agent=("gen_ai.agent.name", "stringValue"))


@register("export_phoenix_parsed", f"""SELECT {_IDS}, 'llm ' || model AS name, workflow_id AS session, length(model) + 11000 + 17 AS input_length,
  CASE WHEN error IS NULL THEN '{{"n":' || latency_ms || '}}' END AS output FROM calls""", raw=True)
def q_export_phoenix_parsed(spark, sf):
    """Spans with whole bodies as input and output values, parsed back."""
    spans = _span(ex.phoenix_spans(_with_bodies(calls(spark, sf))), session=("session.id", "stringValue"), input=("input.value", "stringValue"), output=("output.value", "stringValue"))
    return spans.withColumn("input_length", F.length("input").cast("long")).drop("input")


_DATA = "json_extract_string(d, '{p}')"


@register("sse_events_parsed", with_sse(f"""SELECT exchange_id, CAST(i - 1 AS INTEGER) AS pos, {_DATA.format(p='$.type')} AS kind,
  {_DATA.format(p='$.choices[0].delta.content')} AS content, {_DATA.format(p='$.delta.text')} AS said,
  CAST({_DATA.format(p='$.usage.completion_tokens')} AS BIGINT) AS used FROM (SELECT exchange_id, datas[i] AS d, i
    FROM sse, generate_series(1, len(datas)) g(i)) x"""), calls_cte=False)
def q_sse_events_parsed(spark, sf):
    """H3: stream events in order, with their text and usage."""
    return en.sse_event_rows(_ex(spark, sf)).select(
        "exchange_id", "pos", F.get_json_object("event", "$.type").alias("kind"), F.get_json_object("event", "$.choices[0].delta.content").alias("content"),
        F.get_json_object("event", "$.delta.text").alias("said"), F.get_json_object("event", "$.usage.completion_tokens").cast("long").alias("used"))


@register("first_token", with_ex("""SELECT exchange_id, 30::BIGINT AS first_ms FROM ex WHERE stream AND NOT failed AND NOT non_llm"""), calls_cte=False)
def q_first_token(spark, sf):
    """Offset of the first non-empty chunk of every stream (some begin with an empty one)."""
    return _ex(spark, sf).where(F.col("chunks").isNotNull()).select("exchange_id", en.ttft_from_chunks(F.col("chunks")).alias("first_ms"))


@register("exchange_log_fields", with_ex(f"SELECT exchange_id, path, h_span AS span, h_workflow AS workflow, {model_sql()} AS model, failed FROM ex"), calls_cte=False)
def q_exchange_log_fields(spark, sf):
    """A3: the exchange log written to shared storage, read back, and some of its fields."""
    path = scratch_dir(spark, "exchange-fields")
    _ex(spark, sf).write.mode("overwrite").parquet(path)
    header = lambda k: F.try_element_at("request_headers", F.lit(k))
    return load_exchanges(spark, path).select(
        "exchange_id", "path", header("x-trace-span").alias("span"), header("x-trace-workflow").alias("workflow"),
        en.request_model(F.col("request_body")).alias("model"), F.col("transport_error").isNotNull().alias("failed"))


_KEPT = f"""FROM ex WHERE {model_sql()} <> 'unknown' OR coalesce(octet_length(encode(request_body)), 0) > 0
     OR (NOT failed AND CASE WHEN h_content_type IS NOT NULL THEN contains(h_content_type, 'text/event-stream') ELSE {stream_sql()} END)"""
_FIELDS = f"""SELECT exchange_id AS id, {model_sql()} AS model, split_part(path, '?', 1) AS endpoint, h_tag AS tags, h_agent AS agent_name, h_workflow AS workflow_id,
  h_span AS span_name, CASE WHEN failed THEN 0 WHEN limited THEN 429 ELSE 200 END::INT AS status_code {_KEPT}"""
_FIELD_NAMES = ["id", "model", "endpoint", "tags", "agent_name", "workflow_id", "span_name", "status_code"]


@register("enrich_calls_fields", with_ex(_FIELDS), calls_cte=False)
def q_enrich_calls_fields(spark, sf):
    """Which exchanges the whole ingest pipeline keeps, and what it reads from line and headers."""
    return enriched(spark, sf).select(*_FIELD_NAMES)


@register("stream_enrich_fields", with_ex(_FIELDS), calls_cte=False)
def q_stream_enrich_fields(spark, sf):
    """The same through the streaming ingest and its store."""
    src = exchange_log(spark, sf)
    store, ck = _dirs(spark, "ingest-fields")
    lv.run_ingest(lv.exchanges_stream(spark, src, 2), store, ck, available_now=True).awaitTermination()
    return load_calls(spark, store).select(*_FIELD_NAMES)


@register("fanout_lines", with_ex(f"SELECT exchange_id AS id, 'jsonl' AS format {_KEPT} UNION ALL SELECT base64(unhex(substr(sha256('span:' || exchange_id), 1, 16))), 'otlp' {_KEPT}"),
          calls_cte=False)
def q_fanout_lines(spark, sf):
    """Each ingested call once in each export sink (call ids; span ids)."""
    src = exchange_log(spark, sf)
    store, ck = _dirs(spark, "fanout-lines")
    jl, ot = scratch_dir(spark, "fan-jsonl"), scratch_dir(spark, "fan-otlp")
    lv.run_ingest(lv.exchanges_stream(spark, src, 2), store, ck, exports={"jsonl": jl, "otlp": ot}, available_now=True).awaitTermination()
    line = lambda path, at, kind: spark.read.text(path).select(F.get_json_object("value", at).alias("id"), F.lit(kind).alias("format"))
    return line(jl, "$.id", "jsonl").union(line(ot, "$.resourceSpans[0].scopeSpans[0].spans[0].spanId", "otlp"))


@register("prompt_counts", with_ex(f"""SELECT prompt_hash AS hash, count(*) AS call_count, min(call_ts) AS first_seen, max(call_ts) AS last_seen,
  substr(arg_min(prompt, (call_ts, id)), 1, 80) AS preview FROM ({_HASHED}) WHERE prompt_hash IS NOT NULL GROUP BY prompt_hash"""), calls_cte=False)
def q_prompt_counts(spark, sf):
    """Calls, first and last use and preview of every prompt fingerprint."""
    return pm.prompt_list(stored_calls(spark, sf)).select("hash", "call_count", "first_seen", "last_seen", "preview")


@register("budget_alerts", f"""SELECT 'month' AS period, date_trunc('month', TIMESTAMP '{AS_OF}')::TIMESTAMP AS period_start, 1.0::DOUBLE AS limit_usd, 1::BIGINT AS alerts,
  true AS reached FROM calls WHERE call_ts >= date_trunc('month', TIMESTAMP '{AS_OF}') HAVING sum(cost_usd) >= 1.0""")
def q_budget_alerts(spark, sf):
    """I4: one throttled alert once the month's spend has reached the limit, however many micro-batches follow."""
    out, ck = _dirs(spark, "budget-alerts")
    lv.budget_monitor(_stream(spark, sf), 1.0, "month", out, ck, as_of=AS_OF, available_now=True).awaitTermination()
    return spark.read.parquet(out).groupBy("period", "period_start", "limit_usd").agg(F.count(F.lit(1)).alias("alerts"), F.bool_and(F.col("spent_usd") >= F.col("limit_usd")).alias("reached"))


# streams are logged in chunks of 64 characters; those within the limit are a prefix
_STREAM_SIZES = """raw AS (SELECT exchange_id, CASE WHEN conv_id % 2 = 0 THEN ': keep-alive' || chr(10) || chr(10) ELSE '' END
      || array_to_string(events, chr(10) || chr(10)) || chr(10) || chr(10) AS s FROM sse1),
  cuts AS (SELECT exchange_id, i, octet_length(encode(parts[i])) AS n FROM (SELECT exchange_id, regexp_extract_all(s, '(?s).{1,64}') AS parts FROM raw), generate_series(1, len(parts)) g(i)),
  summed AS (SELECT exchange_id, sum(n) OVER (PARTITION BY exchange_id ORDER BY i) AS upto FROM cuts),
  sizes AS (SELECT exchange_id, max(upto) AS whole, coalesce(max(upto) FILTER (WHERE upto <= 700), 0) AS taken FROM summed GROUP BY exchange_id)"""
_STREAM_BODY = f"""CASE WHEN length({_SSE_TEXT}) > 0 THEN {_SSE_TEXT}
  WHEN {_TOOL_NAME} IS NOT NULL THEN '[{{"arguments":' || json({_TOOL_ARGS})::VARCHAR || ',"name":"' || {_TOOL_NAME} || '"}}]' END"""


@register("body_limits_stored", f"""{with_sse('SELECT * FROM (WITH ' + _STREAM_SIZES)}, texts AS (SELECT exchange_id, {_STREAM_BODY} AS body FROM sse),
  kept AS (SELECT exchange_id, failed, stream AND NOT failed AND NOT non_llm AS streamed, response_body {_KEPT}
    AND octet_length(encode(replace(coalesce(request_body, ''), '"system":null,', ''))) <= 4000)
  SELECT k.exchange_id AS id, CASE WHEN k.failed THEN NULL
    WHEN k.streamed THEN CASE WHEN whole > 700 THEN '[stream left out: over the limit after ' || taken || ' bytes]'
      WHEN octet_length(encode(body)) > 300 THEN '[stream text left out: limit 300 bytes, ' || octet_length(encode(body)) || ' in all]' END
    WHEN octet_length(encode(k.response_body)) > 600 THEN '[body of ' || octet_length(encode(k.response_body)) || ' bytes left out: limit 600 bytes]' END AS marker,
    CASE WHEN k.failed THEN NULL WHEN k.streamed THEN CASE WHEN whole <= 700 AND octet_length(encode(body)) <= 300 THEN octet_length(encode(body)) END
      WHEN octet_length(encode(k.response_body)) <= 600 THEN octet_length(encode(k.response_body)) END AS n_bytes
  FROM kept k LEFT JOIN sizes USING (exchange_id) LEFT JOIN texts USING (exchange_id))""", calls_cte=False)
def q_body_limits_stored(spark, sf):
    """Which exchanges small size limits keep, and the marker or the size of each stored response."""
    lim = en.Limits(max_request=4000, max_stored_response=600, max_accumulation=700, max_stored_stream=300)
    body = F.col("response_body")
    marked = body.rlike(r"^\[(body of|stream|stream text) .*left out: .*\]$")
    return enriched(spark, sf, limits=lim).select("id", F.when(marked, body).alias("marker"), F.when(~marked, F.octet_length(body)).alias("n_bytes"))
