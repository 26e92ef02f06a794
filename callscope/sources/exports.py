"""Exports of the calls table to observability formats.

Every format is a projection to one JSON/CSV ``line`` per call built with
column expressions (``to_json`` over structs, bodies re-parsed as VARIANT),
so exports run on executors; ``write_lines`` writes them oldest first with
a range-partitioned sort (no single-task ordering).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.predicates import is_error_a
from callscope.schema import BODY_COLUMNS, CALL_COLUMNS

# Export field names and limits.
CSV_COLUMNS = ["id", "timestamp", "provider", "model", "endpoint", "status_code", "latency_ms",
               "ttft_ms", "input_tokens", "output_tokens", "cost_usd", "error", "provider_request_id"]
OTLP_PROVIDER_NAMES = {
    "openai": "openai", "anthropic": "anthropic", "bedrock": "aws.bedrock", "azure": "azure.ai.openai",
    "google": "gcp.vertex_ai", "cohere": "cohere", "deepseek": "deepseek", "groq": "groq",
    "mistral": "mistral_ai", "perplexity": "perplexity", "xai": "x_ai", "ollama": "ollama",
}
DEFAULT_SOURCE_NAME = "callscope"  # tag / session / service name written into exports


def iso_ms(ts: Column) -> Column:
    """UTC ISO-8601 with milliseconds and ``Z`` (the stored timestamp text)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_offset(ts: Column) -> Column:
    """UTC ISO-8601 with milliseconds (left out when zero) and a ``+00:00`` offset."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), r"\.000$", ""), F.lit("+00:00"))


def end_ts(df_ts: Column, latency_ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(df_ts) + F.coalesce(latency_ms, F.lit(0)))


def truncate_bytes(s: Column, limit: int | None) -> Column:
    """At most ``limit`` UTF-8 bytes, cut at a character boundary (None: the whole text)."""
    if limit is None:
        return s
    cut = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, limit).cast("string"))
    cut = F.regexp_replace(cut, "�$", "")
    return F.when(F.octet_length(s) <= limit, s).otherwise(cut)


def parsed_body(s: Column, limit: int | None = None) -> Column:
    """Body as JSON (whole, or its first ``limit`` bytes) or JSON null."""
    return F.coalesce(F.try_parse_json(truncate_bytes(s, limit)), F.parse_json(F.lit("null")))


def named_id(name: str, key: Column, nbytes: int) -> Column:
    """The first bytes of a digest of the call's id: a replayed task or batch writes the same id again."""
    return F.substring(F.unhex(F.sha2(F.concat(F.lit(f"{name}:"), key), 256)), 1, nbytes)


def event_uuid(name: str, key: Column) -> Column:
    h = F.lower(F.hex(named_id(name, key, 16)))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def without_bodies(df: DataFrame) -> DataFrame:
    """The same records with both bodies removed (metadata-only exports)."""
    for c in BODY_COLUMNS:
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def _out(df: DataFrame, line: Column) -> DataFrame:
    return df.select("id", "call_ts", line.alias("line"))


def jsonl(df: DataFrame) -> DataFrame:
    """A5: one JSON object per call with all 22 fields (NULLs kept)."""
    fields = [F.col(c).alias(c) if c != "call_ts" else iso_ms(F.col("call_ts")).alias("timestamp")
              for c in CALL_COLUMNS]
    return _out(df, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def csv_fields(df: DataFrame) -> DataFrame:
    """The 13 CSV columns as text (cost with 8 decimals, NULL -> empty)."""
    def txt(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(
        txt("id").alias("id"), iso_ms(F.col("call_ts")).alias("timestamp"), txt("provider").alias("provider"),
        txt("model").alias("model"), txt("endpoint").alias("endpoint"), txt("status_code").alias("status_code"),
        txt("latency_ms").alias("latency_ms"), txt("ttft_ms").alias("ttft_ms"),
        txt("input_tokens").alias("input_tokens"), txt("output_tokens").alias("output_tokens"),
        F.when(F.col("cost_usd").isNull(), F.lit("")).otherwise(F.format_string("%.8f", F.col("cost_usd")))
        .alias("cost_usd"),
        txt("error").alias("error"), txt("provider_request_id").alias("provider_request_id"),
        F.col("call_ts").alias("_ts"))


def csv_quote(c: Column) -> Column:
    """Quote only fields containing a comma, quote or line break; quotes doubled."""
    return F.when(c.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)


def csv_lines(df: DataFrame) -> DataFrame:
    """A6 as lines (header is written by ``write_csv``)."""
    f = csv_fields(df)
    return f.select("id", F.col("_ts").alias("call_ts"),
                    F.concat_ws(",", *[csv_quote(F.col(c)) for c in CSV_COLUMNS]).alias("line"))


#: A7's header line (``write_csv_all_quoted`` writes it first).
ALL_QUOTED_HEADER = "id,timestamp,provider,model,endpoint,status_code,latency_ms,ttft_ms,input_tokens,output_tokens,cost_usd,error"


def csv_all_quoted(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All calls (or the newest ``limit``), 12 columns, every field quoted, missing/zero -> empty."""
    from callscope.operators.filters import list_calls

    top = df if limit is None else list_calls(df, None, limit)

    def falsy(c):
        return F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit("")).otherwise(F.col(c).cast("string"))
    cols = [F.col("id"), iso_ms(F.col("call_ts")), F.col("provider"), F.col("model"), F.col("endpoint"),
            F.col("status_code").cast("string"), F.col("latency_ms").cast("string"), falsy("ttft_ms"),
            falsy("input_tokens"), falsy("output_tokens"),
            F.when(F.col("cost_usd").isNull() | (F.col("cost_usd") == 0), F.lit("")).otherwise(
                F.col("cost_usd").cast("string")),
            F.coalesce(F.col("error"), F.lit(""))]
    q = [F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"')) for c in cols]
    return top.select("id", "call_ts", F.concat_ws(",", *q).alias("line"))


def _obj(*pairs: tuple[str, Column, Column | None]) -> Column:
    """An object as a map of variants: a NULL value is written as null, a pair whose condition is false is left out."""
    null = F.parse_json(F.lit("null"))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v.cast("variant"), null).alias("value"),
                                 (F.lit(True) if when is None else when).alias("on")) for k, v, when in pairs])
    kept = F.filter(entries, lambda e: e["on"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def _plain(name: str, value: Column | None = None, when: Column | None = None) -> tuple:
    return name, F.col(name) if value is None else value, when


def _call_facts(*names: str) -> list[tuple]:
    """The named columns, and agent and workflow where they are known."""
    return [_plain(n) for n in names] + [_plain(n, None, F.col(n).isNotNull()) for n in ("agent_name", "workflow_id")]


def langfuse(df: DataFrame, body_bytes: int | None = None) -> DataFrame:
    """One batch ingestion event (generation-create) per call; unknown values are null, absent agent and workflow are left out.

    Bodies are exported whole (or their first ``body_bytes`` bytes). The event id is derived from the call id.
    """
    inp, out = F.col("input_tokens"), F.col("output_tokens")
    body = F.struct(
        F.col("id").alias("id"), F.coalesce(F.col("workflow_id"), F.col("id")).alias("traceId"),
        F.lit("llm-call").alias("name"), iso_ms(F.col("call_ts")).alias("startTime"),
        iso_offset(end_ts(F.col("call_ts"), F.col("latency_ms"))).alias("endTime"),
        F.col("model").alias("model"), parsed_body(F.col("request_body"), body_bytes).alias("input"),
        parsed_body(F.col("response_body"), body_bytes).alias("output"),
        F.struct(inp.alias("input"), out.alias("output"),
                 F.when(inp.isNotNull() & out.isNotNull(), inp + out).alias("total")).alias("usage"),
        _obj(*_call_facts("provider", "endpoint", "status_code", "cost_usd", "latency_ms")).alias("metadata"),
        F.when(F.col("error").isNotNull(), F.lit("ERROR")).otherwise(F.lit("DEFAULT")).alias("level"))
    event = F.struct(event_uuid("generation", F.col("id")).alias("id"), F.lit("generation-create").alias("type"), body.alias("body"))
    return _out(df, F.to_json(F.struct(F.array(event).alias("batch")), {"ignoreNullFields": "false"}))


def langsmith(df: DataFrame, source_name: str = DEFAULT_SOURCE_NAME, body_bytes: int | None = None) -> DataFrame:
    """One run object per call, epoch-millisecond times, tags = [source, provider, agent?]; an absent workflow is left out of ``extra``."""
    start = F.unix_millis("call_ts")
    facts = [_plain(n) for n in ("model", "provider", "input_tokens", "output_tokens", "cost_usd", "status_code")]
    run = F.struct(
        F.col("id").alias("id"), F.lit("llm-call").alias("name"), F.lit("llm").alias("run_type"),
        F.struct(parsed_body(F.col("request_body"), body_bytes).alias("messages")).alias("inputs"),
        F.struct(parsed_body(F.col("response_body"), body_bytes).alias("output")).alias("outputs"),
        start.alias("start_time"), (start + F.coalesce(F.col("latency_ms"), F.lit(0))).alias("end_time"),
        _obj(*facts, _plain("workflow_id", None, F.col("workflow_id").isNotNull())).alias("extra"),
        F.col("error").alias("error"), F.lit(source_name).alias("session_name"),
        F.array_compact(F.array(F.lit(source_name), F.col("provider"), F.col("agent_name"))).alias("tags"))
    return _out(df, F.to_json(run, {"ignoreNullFields": "false"}))


def weave(df: DataFrame, project_id: str | None = None, body_bytes: int | None = None) -> DataFrame:
    """A10: upsert-batch call per record with per-model usage (NULL tokens -> 0); ``project_id`` (live exports) is added where given."""
    p = F.coalesce(F.col("input_tokens"), F.lit(0))
    c = F.coalesce(F.col("output_tokens"), F.lit(0))
    usage = F.create_map(F.col("model"), F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"),
                                                  (p + c).alias("total_tokens"), F.lit(1).alias("requests")))
    call = F.struct(
        *([F.lit(project_id).alias("project_id")] if project_id else []),
        F.col("id").alias("id"), F.lit("llm_call").alias("op_name"), iso_ms(F.col("call_ts")).alias("started_at"),
        iso_offset(end_ts(F.col("call_ts"), F.col("latency_ms"))).alias("ended_at"),
        F.struct(F.col("model").alias("model"), parsed_body(F.col("request_body"), body_bytes).alias("messages")).alias("inputs"),
        parsed_body(F.col("response_body"), body_bytes).alias("output"), F.struct(usage.alias("usage")).alias("summary"),
        _obj(*_call_facts("provider", "endpoint", "status_code", "cost_usd", "latency_ms")).alias("attributes"))
    return _out(df, F.to_json(F.struct(F.array(call).alias("calls")), {"ignoreNullFields": "false"}))


_VALUE_KINDS = {"stringValue": "string", "intValue": "bigint", "doubleValue": "double"}


def _attr(key: str, kind: str, value: Column, when: Column | None = None) -> Column:
    """OTLP attribute ``{key, value: {<kind>: v}}``; unused kinds are NULL and dropped by to_json."""
    vals = [(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in _VALUE_KINDS.items()]
    a = F.struct(F.lit(key).alias("key"), F.struct(*vals).alias("value"))
    return a if when is None else F.when(when, a)


def _provider_name(p: Column) -> Column:
    m = F.create_map(*[x for k, v in OTLP_PROVIDER_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, p), p)


def _status() -> Column:
    return F.when(is_error_a(), F.struct(F.lit(2).alias("code"),
                                         F.coalesce(F.col("error"), F.lit("upstream error")).alias("message"))) \
        .otherwise(F.struct(F.lit(1).alias("code"), F.lit(None).cast("string").alias("message")))


def otlp_spans(df: DataFrame, service_name: str = DEFAULT_SOURCE_NAME, version: str = "0") -> DataFrame:
    """One OTLP/JSON resourceSpans document per call (gen_ai + OpenInference attributes)."""
    op = F.when(F.col("endpoint").contains("embedding"), F.lit("embeddings")).otherwise(F.lit("chat"))
    i, o = F.col("input_tokens"), F.col("output_tokens")
    attrs = F.array_compact(F.array(
        _attr("gen_ai.system", "stringValue", _provider_name(F.col("provider"))),
        _attr("gen_ai.operation.name", "stringValue", op),
        _attr("gen_ai.request.model", "stringValue", F.col("model")),
        _attr("http.status_code", "intValue", F.col("status_code").cast("long")),
        _attr("openinference.span.kind", "stringValue", F.lit("LLM")),
        _attr("llm.model_name", "stringValue", F.col("model")),
        _attr("llm.provider", "stringValue", F.col("provider")),
        _attr("gen_ai.usage.input_tokens", "intValue", i, i.isNotNull()),
        _attr("llm.token_count.prompt", "intValue", i, i.isNotNull()),
        _attr("gen_ai.usage.output_tokens", "intValue", o, o.isNotNull()),
        _attr("llm.token_count.completion", "intValue", o, o.isNotNull()),
        _attr("llm.token_count.total", "intValue", i + o, i.isNotNull() & o.isNotNull()),
        _attr("llm.cost_usd", "doubleValue", F.col("cost_usd"), F.col("cost_usd").isNotNull()),
        _attr("llm.ttft_ms", "intValue", F.col("ttft_ms"), F.col("ttft_ms").isNotNull()),
        _attr("error.type", "stringValue", F.col("error"), F.col("error").isNotNull()),
        _attr("gen_ai.agent.name", "stringValue", F.col("agent_name"), F.col("agent_name").isNotNull()),
        _attr("llm.agent_name", "stringValue", F.col("agent_name"), F.col("agent_name").isNotNull()),
        _attr("gen_ai.workflow.id", "stringValue", F.col("workflow_id"), F.col("workflow_id").isNotNull()),
        _attr("gen_ai.span.name", "stringValue", F.col("span_name"), F.col("span_name").isNotNull())))
    start = F.unix_micros("call_ts") * 1000
    end = start + F.coalesce(F.col("latency_ms"), F.lit(0)) * 1_000_000
    events = F.when(F.col("error").isNotNull(), F.array(F.struct(
        F.lit("exception").alias("name"),
        F.array(_attr("exception.message", "stringValue", F.col("error"))).alias("attributes"))))
    span = F.struct(
        F.base64(named_id("trace", F.col("id"), 16)).alias("traceId"), F.base64(named_id("span", F.col("id"), 8)).alias("spanId"),
        F.coalesce(F.col("span_name"), F.concat_ws(" ", op, F.col("model"))).alias("name"),
        F.lit(3).alias("kind"), start.cast("string").alias("startTimeUnixNano"),
        end.cast("string").alias("endTimeUnixNano"), attrs.alias("attributes"), _status().alias("status"),
        events.alias("events"))
    return _out(df, F.to_json(_envelope(span, service_name, version, service_name, version)))


def _envelope(span: Column, service: str, version: str | None, scope: str, scope_version: str) -> Column:
    facts = {"service.name": service} | ({} if version is None else {"service.version": version})
    resource = F.struct(F.array(*[_attr(k, "stringValue", F.lit(v)) for k, v in facts.items()]).alias("attributes"))
    scope_spans = F.struct(F.struct(F.lit(scope).alias("name"), F.lit(scope_version).alias("version")).alias("scope"),
                           F.array(span).alias("spans"))
    return F.struct(F.array(F.struct(resource.alias("resource"),
                                     F.array(scope_spans).alias("scopeSpans"))).alias("resourceSpans"))


def phoenix_spans(df: DataFrame, service_name: str = DEFAULT_SOURCE_NAME, body_bytes: int | None = None) -> DataFrame:
    """OpenInference span per call; session.id = workflow; bodies (whole, or their first ``body_bytes`` bytes) as input/output values."""
    i, o = F.col("input_tokens"), F.col("output_tokens")
    req, resp = F.col("request_body"), F.col("response_body")
    attrs = F.array_compact(F.array(
        _attr("openinference.span.kind", "stringValue", F.lit("LLM")),
        _attr("llm.model_name", "stringValue", F.col("model")),
        _attr("llm.provider", "stringValue", F.col("provider")),
        _attr("http.status_code", "intValue", F.col("status_code").cast("long")),
        _attr("llm.token_count.prompt", "intValue", i, i.isNotNull()),
        _attr("llm.token_count.completion", "intValue", o, o.isNotNull()),
        _attr("llm.token_count.total", "intValue", i + o, i.isNotNull() & o.isNotNull()),
        _attr("llm.agent_name", "stringValue", F.col("agent_name"), F.col("agent_name").isNotNull()),
        _attr("session.id", "stringValue", F.col("workflow_id"), F.col("workflow_id").isNotNull()),
        _attr("input.value", "stringValue", truncate_bytes(req, body_bytes), req.isNotNull()),
        _attr("input.mime_type", "stringValue", F.lit("application/json"), req.isNotNull()),
        _attr("output.value", "stringValue", truncate_bytes(resp, body_bytes), resp.isNotNull()),
        _attr("output.mime_type", "stringValue", F.lit("application/json"), resp.isNotNull())))
    start = F.unix_micros("call_ts") * 1000
    end = start + F.coalesce(F.col("latency_ms"), F.lit(0)) * 1_000_000
    span = F.struct(
        F.base64(named_id("trace", F.col("id"), 16)).alias("traceId"), F.base64(named_id("span", F.col("id"), 8)).alias("spanId"),
        F.concat(F.lit("llm "), F.col("model")).alias("name"), F.lit(3).alias("kind"),
        start.cast("string").alias("startTimeUnixNano"), end.cast("string").alias("endTimeUnixNano"),
        attrs.alias("attributes"), _status().alias("status"))
    return _out(df, F.to_json(_envelope(span, service_name, None, "openinference", "1.0.0")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write export lines oldest first (range-partitioned global sort, then text files)."""
    lines.orderBy("call_ts", "id").select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A6 to CSV files with a header; quoting only where needed, quotes doubled, NULL -> empty."""
    (csv_fields(df).orderBy("_ts", "id").drop("_ts").write.mode("overwrite")
     .option("header", "true").option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("emptyValue", "").option("nullValue", "").csv(path))


def write_csv_all_quoted(df: DataFrame, path: str, limit: int | None = None) -> None:
    """A7 to text files, newest first, the header line at the top of the first."""
    lines = csv_all_quoted(df, limit)
    head = df.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(None).cast("timestamp").alias("call_ts"), F.lit("").alias("id"), F.lit(ALL_QUOTED_HEADER).alias("line"))
    (head.unionByName(lines.select(F.lit(1).alias("k"), "call_ts", "id", "line")).orderBy("k", F.col("call_ts").desc(), F.col("id").desc())
     .select("line").write.mode("overwrite").text(path))


def report_json(report: DataFrame, period_from: str = "(all time)", period_to: str = "now") -> DataFrame:
    """The cost report (D12) as one JSON document, models by descending cost.

    One aggregate over the report rows (one row per model plus the total).
    """
    tot = F.col("is_total")
    agg = report.agg(
        F.max(F.when(tot, F.col("calls"))).alias("total_calls"),
        F.max(F.when(tot, F.col("cost_usd"))).alias("total_cost_usd"),
        F.sort_array(F.collect_list(F.when(~tot, F.struct(
            (-F.col("cost_usd")).alias("k"), F.col("model").alias("model"), F.col("calls").alias("calls"),
            F.col("input_tokens").alias("input_tokens"), F.col("output_tokens").alias("output_tokens"),
            F.col("cost_usd").alias("cost_usd"))))).alias("m"))
    models = F.transform(F.col("m"), lambda x: F.struct(
        x["model"].alias("model"), x["calls"].alias("calls"), x["input_tokens"].alias("input_tokens"),
        x["output_tokens"].alias("output_tokens"), x["cost_usd"].alias("cost_usd")))
    return agg.select(F.to_json(F.struct(
        F.struct(F.lit(period_from).alias("from"), F.lit(period_to).alias("to")).alias("period"),
        F.coalesce(F.col("total_calls"), F.lit(0)).alias("total_calls"),
        F.coalesce(F.col("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        models.alias("models"))).alias("document"))


def report_lines(report: DataFrame, fmt: str = "markdown") -> DataFrame:
    """The cost report as ordered text lines ``(seq, line)``: markdown table or plain text."""
    spark = report.sparkSession
    models = report.where(~F.col("is_total"))
    tot = report.where(F.col("is_total"))
    from pyspark.sql import Window

    w = Window.orderBy(F.col("cost_usd").desc(), F.col("model"))
    if fmt == "markdown":
        head = spark.createDataFrame([(0, "| Model | Calls | Input | Output | Cost (USD) |"),
                                      (1, "|---|---:|---:|---:|---:|")], "seq int, line string")
        body = models.select((F.row_number().over(w) + 1).alias("seq"), F.format_string(
            "| %s | %d | %d | %d | $%.4f |", "model", "calls", "input_tokens", "output_tokens", "cost_usd")
            .alias("line"))
        foot = tot.select(F.lit(1 << 30).alias("seq"), F.format_string(
            "| **Total** | %d | | | $%.4f |", "calls", "cost_usd").alias("line"))
    else:
        head = spark.createDataFrame([(0, "model                                      calls        cost")],
                                     "seq int, line string")
        body = models.select(F.row_number().over(w).alias("seq"), F.format_string(
            "%-40s %8d  $%10.4f", "model", "calls", "cost_usd").alias("line"))
        foot = tot.select(F.lit(1 << 30).alias("seq"), F.format_string(
            "%-40s %8d  $%10.4f", F.lit("total"), "calls", "cost_usd").alias("line"))
    return head.unionByName(body).unionByName(foot)
