"""Raw exchange log -> ``calls`` table.

Every stage is a per-row expression (VARIANT JSON access, higher-order
functions over the chunk array), so the whole job is a single narrow
projection: no shuffle, no cross-row state, and the same code runs on a
batch DataFrame or a streaming one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import jsonx as J
from callscope.functions.prices import price_expr
from callscope.operators.pricing import cache_aware_cost
from callscope.operators.routing import provider_expr, route_expr
from callscope.schema import CALL_COLUMNS

MB = 1024 * 1024


@dataclass
class Limits:
    """Body size limits in bytes; None (the default) keeps bodies of every size."""

    max_request: int | None = None
    max_stored_response: int | None = None
    max_accumulation: int | None = None
    max_stored_stream: int | None = None


#: The limits of the capture path, for callers that want them.
CAPTURE_LIMITS = Limits(16 * MB, 10 * MB, 4 * MB, 256 * 1024)


def over(size: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else size > F.lit(limit)


@dataclass
class EnrichOptions:
    routes: list[tuple[str, str]] = field(default_factory=list)
    overrides: dict | None = None
    redact_fields: list[str] = field(default_factory=list)
    store_request_bodies: bool = True
    limits: Limits = field(default_factory=Limits)


def header(m: str, key: str) -> Column:
    return F.try_element_at(F.col(m), F.lit(key))


# ---------------------------------------------------------------- H1, H2
def request_model(body: Column) -> Column:
    """H1: request ``model`` when it is a JSON string, else 'unknown' (also for bad JSON)."""
    return F.coalesce(J.jstr(J.parse(body), "$.model"), F.lit("unknown"))


def request_stream(body: Column) -> Column:
    """H1: request ``stream`` flag when it is a JSON boolean, else false."""
    return F.coalesce(J.jbool(J.parse(body), "$.stream"), F.lit(False))


def body_usage(body: Column) -> Column:
    """H2 (+H18 inputs): struct(input, output, cache_write, cache_read, cached) from a JSON body.

    input = usage.prompt_tokens or usage.input_tokens (integers only); output
    defaults to 0; no input -> all NULL.
    """
    return body_usage_v(J.parse(body))


def body_usage_v(v: Column) -> Column:
    """H2 on an already parsed (VARIANT) body."""
    inp = F.coalesce(J.jint(v, "$.usage.prompt_tokens"), J.jint(v, "$.usage.input_tokens"))
    out = F.coalesce(J.jint(v, "$.usage.completion_tokens"), J.jint(v, "$.usage.output_tokens"), F.lit(0))
    return F.struct(
        inp.alias("input_tokens"), F.when(inp.isNotNull(), out).alias("output_tokens"),
        J.jint(v, "$.usage.cache_creation_input_tokens").alias("cache_write"),
        J.jint(v, "$.usage.cache_read_input_tokens").alias("cache_read"),
        J.jint(v, "$.usage.prompt_tokens_details.cached_tokens").alias("cached"))


# ---------------------------------------------------------------- H3
def sse_stream_text(chunks: Column) -> Column:
    """Concatenated chunk payloads (events split across chunks are healed here)."""
    return F.array_join(F.transform(chunks, lambda c: F.coalesce(c["data"], F.lit(""))), "")


def sse_data_lines(text: Column) -> Column:
    """``data: `` payloads of every line except ``[DONE]``, in stream order."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.regexp_replace(l, "\r$", ""))
    data = F.filter(lines, lambda l: l.startswith("data: ")
                    & (J.unicode_trim(F.substring(l, 7, 1 << 30)) != F.lit("[DONE]")))
    return F.transform(data, lambda l: F.substring(l, 7, 1 << 30))


def sse_events(chunks: Column) -> Column:
    """H3: array<variant> of parsed events (NULL entries for malformed JSON)."""
    return F.transform(sse_data_lines(sse_stream_text(chunks)), lambda d: F.try_parse_json(d))


# ---------------------------------------------------------------- H4, H19
def sse_usage(events: Column) -> Column:
    """H4: last non-NULL input/output over events; top-level ``usage`` then ``message.usage``."""
    pairs = F.flatten(F.transform(events, lambda e: F.array(
        F.struct(F.coalesce(J.jint(e, "$.usage.prompt_tokens"), J.jint(e, "$.usage.input_tokens")).alias("i"),
                 F.coalesce(J.jint(e, "$.usage.completion_tokens"), J.jint(e, "$.usage.output_tokens")).alias("o")),
        F.struct(J.jint(e, "$.message.usage.input_tokens").alias("i"),
                 J.jint(e, "$.message.usage.output_tokens").alias("o")))))
    init = F.struct(F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("o"))
    acc = F.aggregate(pairs, init, lambda a, x: F.struct(F.coalesce(x["i"], a["i"]).alias("i"),
                                                         F.coalesce(x["o"], a["o"]).alias("o")))
    return F.struct(acc["i"].alias("input_tokens"),
                    F.when(acc["i"].isNotNull(), F.coalesce(acc["o"], F.lit(0))).alias("output_tokens"))


def sse_cache_counts(events: Column) -> Column:
    """Last positive cache counts (message.usage first, then usage, within an event)."""
    z = F.lit(None).cast("bigint")
    pairs = F.flatten(F.transform(events, lambda e: F.array(
        F.struct(J.jint(e, "$.message.usage.cache_creation_input_tokens").alias("w"),
                 J.jint(e, "$.message.usage.cache_read_input_tokens").alias("r"), z.alias("c")),
        F.struct(J.jint(e, "$.usage.cache_creation_input_tokens").alias("w"),
                 J.jint(e, "$.usage.cache_read_input_tokens").alias("r"),
                 J.jint(e, "$.usage.prompt_tokens_details.cached_tokens").alias("c")))))
    zero = F.lit(0).cast("bigint")
    init = F.struct(zero.alias("w"), zero.alias("r"), zero.alias("c"))

    def step(a, x):
        return F.struct(F.when(x["w"] > 0, x["w"]).otherwise(a["w"]).alias("w"),
                        F.when(x["r"] > 0, x["r"]).otherwise(a["r"]).alias("r"),
                        F.when(x["c"] > 0, x["c"]).otherwise(a["c"]).alias("c"))
    return F.aggregate(pairs, init, step)


# ---------------------------------------------------------------- H5
def _tool_json(tools: Column) -> Column:
    return F.to_json(F.transform(tools, lambda t: F.struct(
        F.coalesce(F.try_parse_json(t["args"]), t["args"].cast("variant")).alias("arguments"),
        t["name"].alias("name"))))


def sse_text_parts(events: Column) -> Column:
    """H5, first half: struct(text, tool-call fragments, marks of tool blocks), each built once.

    * text: ``choices[0].delta.content`` and ``delta.text`` concatenated in order;
    * first dialect: every tool-call fragment (index, name, argument piece);
    * second dialect: ``content_block_start`` of type tool_use opens a
      block, ``input_json_delta`` fragments belong to the latest block.
    """
    text = F.array_join(F.transform(events, lambda e: F.concat(
        F.coalesce(J.jstr(e, "$.choices[0].delta.content"), F.lit("")),
        F.coalesce(J.jstr(e, "$.delta.text"), F.lit("")))), "")
    tcs = F.flatten(F.transform(events, lambda e: F.coalesce(F.transform(
        J.jarray(e, "$.choices[0].delta.tool_calls"),
        lambda tc: F.struct(
            F.coalesce(F.when(J.jint(tc, "$.index") >= 0, J.jint(tc, "$.index")), F.lit(0).cast("bigint")).alias("idx"),
            J.jstr(tc, "$.function.name").alias("name"),
            J.jstr(tc, "$.function.arguments").alias("args"))),
        F.array().cast("array<struct<idx:bigint,name:string,args:string>>"))))
    def mark(e):
        opens = ((J.jstr(e, "$.type") == "content_block_start") & (J.jstr(e, "$.content_block.type") == "tool_use"))
        piece = ((J.jstr(e, "$.type") == "content_block_delta") & (J.jstr(e, "$.delta.type") == "input_json_delta"))
        return F.struct(F.when(opens, J.jstr(e, "$.content_block.name")).alias("name"),
                        F.when(piece, J.jstr(e, "$.delta.partial_json")).alias("piece"))

    marks = F.filter(F.transform(events, mark), lambda m: m["name"].isNotNull() | m["piece"].isNotNull())
    return F.struct(text.alias("text"), tcs.alias("tcs"), marks.alias("marks"))


def _blocks(marks: Column) -> Column:
    """Second-dialect tool blocks: each start with the pieces up to the next one, joined once (pieces before the first start are dropped)."""
    n = F.size(marks)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(marks, i)["name"].isNotNull())).otherwise(
        F.array().cast("array<int>"))
    # a start is zipped with the next one; behind the last there is none
    return F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.struct(
        F.element_at(marks, a)["name"].alias("name"),
        F.array_join(F.slice(marks, a + 1, F.coalesce(b, n + 1) - a - 1)["piece"], "").alias("args")))


def sse_text_final(parts: Column) -> Column:
    """H5, second half: text wins, else first-dialect tools by ascending index (first
    non-empty name, fragments concatenated), else second-dialect blocks; '' if nothing.
    Arguments are embedded as JSON when they parse, else as a string."""
    tcs, blocks = parts["tcs"], _blocks(parts["marks"])
    idxs = F.array_sort(F.array_distinct(F.transform(tcs, lambda t: t["idx"])))
    oai = F.transform(idxs, lambda k: F.struct(
        F.coalesce(F.try_element_at(F.filter(tcs, lambda t: (t["idx"] == k) & t["name"].isNotNull()
                                             & (t["name"] != "")), F.lit(1))["name"], F.lit("")).alias("name"),
        F.array_join(F.transform(F.filter(tcs, lambda t: (t["idx"] == k) & t["args"].isNotNull()),
                                 lambda t: t["args"]), "").alias("args")))
    return (F.when(F.length(parts["text"]) > 0, parts["text"])
            .when(F.size(tcs) > 0, _tool_json(oai))
            .when(F.size(blocks) > 0, _tool_json(blocks))
            .otherwise(F.lit("")))


def with_sse_text(df: DataFrame, events_col: str, out: str) -> DataFrame:
    """H5 as two projections so the event array is walked once."""
    return (df.withColumn("_parts", sse_text_parts(F.col(events_col)))
            .withColumn(out, sse_text_final(F.col("_parts"))).drop("_parts"))


# ---------------------------------------------------------------- H11, H16
def accepted_chunks(chunks: Column, max_accumulation: int | None) -> Column:
    """Chunks kept for parsing: the longest prefix whose total size stays within the limit (None: all)."""
    if max_accumulation is None:
        return chunks
    sizes = F.transform(chunks, lambda c: F.coalesce(F.octet_length(c["data"]), F.lit(0)))
    # sizes are not negative, so the chunks within the limit form a prefix: one pass counts them
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("n"))
    kept = F.aggregate(sizes, zero, lambda a, x: F.struct(
        (a["total"] + x).alias("total"), F.when(a["total"] + x <= F.lit(max_accumulation), a["n"] + 1).otherwise(a["n"]).alias("n")))
    return F.when(chunks.isNotNull(), F.slice(chunks, 1, kept["n"]))


def ttft_from_chunks(chunks: Column) -> Column:
    """Offset of the first non-empty chunk."""
    return F.try_element_at(F.filter(chunks, lambda c: F.coalesce(F.octet_length(c["data"]), F.lit(0)) > 0),
                            F.lit(1))["offset_ms"]


# ---------------------------------------------------------------- H12-H15
def trace_ids() -> Column:
    """W3C traceparent (exactly 4 dash parts) else x-trace-id / x-b3-traceid and
    x-parent-span-id / x-b3-parentspanid."""
    tp = F.split(header("request_headers", "traceparent"), "-", 4)
    ok = F.coalesce(F.size(tp) == 4, F.lit(False))
    tid = F.when(ok, F.try_element_at(tp, F.lit(2))).otherwise(
        F.coalesce(header("request_headers", "x-trace-id"), header("request_headers", "x-b3-traceid")))
    pid = F.when(ok, F.try_element_at(tp, F.lit(3))).otherwise(
        F.coalesce(header("request_headers", "x-parent-span-id"), header("request_headers", "x-b3-parentspanid")))
    return F.struct(tid.alias("trace_id"), pid.alias("parent_id"))


def endpoint_path(path: Column) -> Column:
    """Request path without the query string."""
    return F.substring_index(path, "?", 1)


def is_sse(stream_flag: Column) -> Column:
    """Response content-type says event-stream; without the header, the request flag."""
    ct = header("response_headers", "content-type")
    return F.when(ct.isNotNull(), ct.contains("text/event-stream")).otherwise(stream_flag)


# ---------------------------------------------------------------- H20
def enrich_calls(ex: DataFrame, opts: EnrichOptions | None = None) -> DataFrame:
    """The whole capture pipeline as staged narrow projections over the exchange log.

    Drops non-LLM exchanges on the failure and buffered paths (streams are
    always kept) and, where the caller sets that limit, oversized requests;
    usage is read from the original body, whatever is stored. Then derives
    every CALLS column. Each body is parsed once into a VARIANT column and
    every stage reads the previous stage's columns by name.
    """
    o = opts or EnrichOptions()
    lim = o.limits
    body = F.col("request_body")
    base = ex.where(~over(F.coalesce(F.octet_length(body), F.lit(0)), lim.max_request))

    # stage 1: request parse, routing, trace headers
    s1 = base.withColumn("_rv", J.parse(body))
    s1 = s1.select(
        "*",
        F.coalesce(J.jstr(F.col("_rv"), "$.model"), F.lit("unknown")).alias("_model"),
        F.coalesce(J.jbool(F.col("_rv"), "$.stream"), F.lit(False)).alias("_stream"),
        trace_ids().alias("_trace"),
        route_expr(F.col("path"), o.routes, F.col("upstream")).alias("_upstream"))
    llm = (F.col("_model") != "unknown") | (F.coalesce(F.octet_length(body), F.lit(0)) > 0)
    failed = F.col("transport_error").isNotNull()
    s2 = s1.select("*", llm.alias("_llm"), failed.alias("_failed"),
                   (is_sse(F.col("_stream")) & ~failed).alias("_sse"))
    s2 = s2.where(F.col("_sse") | F.col("_llm"))

    # stage 2: stored request body (+ its fingerprint), accepted stream chunks
    keep_req = F.col("_llm") & F.lit(bool(o.store_request_bodies))
    if o.redact_fields:
        stored = F.when(keep_req, J.redact(body, o.redact_fields))
        s3 = s2.select("*", stored.alias("_req"))
        s3 = s3.withColumn("_reqv", J.parse(F.col("_req")))
    else:
        s3 = s2.select("*", F.when(keep_req, body).alias("_req"), F.when(keep_req, F.col("_rv")).alias("_reqv"))
    s3 = s3.select("*", F.when(F.col("_sse"), accepted_chunks(F.col("chunks"), lim.max_accumulation)).alias("_acc"))

    # stage 3: stream events (parsed once), chunk byte counts
    size_of = lambda arr: F.aggregate(
        F.transform(arr, lambda c: F.coalesce(F.octet_length(c["data"]), F.lit(0))), F.lit(0).cast("bigint"),
        lambda a, x: a + x)
    s4 = s3.select("*", sse_events(F.col("_acc")).alias("_events"),
                   size_of(F.col("_acc")).alias("_acc_bytes"),
                   over(size_of(F.col("chunks")), lim.max_accumulation).alias("_overflow"))
    s4 = with_sse_text(s4, "_events", "_text")

    # stage 4: stored response body
    resp = F.col("response_body")
    big = over(F.coalesce(F.octet_length(resp), F.lit(0)), lim.max_stored_response)
    resp_stored = F.when(big, F.format_string(
        "[body of %d bytes left out: limit %d bytes]",
        F.octet_length(resp), F.lit(lim.max_stored_response or 0).cast("bigint"))).otherwise(resp)
    text = F.col("_text")
    stream_body = (F.when(F.col("_overflow"), F.format_string("[stream left out: over the limit after %d bytes]",
                                                              F.col("_acc_bytes")))
                   .when(F.length(text) == 0, F.lit(None).cast("string"))
                   .when(over(F.octet_length(text), lim.max_stored_stream),
                         F.format_string("[stream text left out: limit %d bytes, %d in all]",
                                         F.lit(lim.max_stored_stream or 0).cast("bigint"), F.octet_length(text)))
                   .otherwise(text))
    s5 = s4.select("*", F.when(F.col("_failed"), F.lit(None).cast("string")).when(F.col("_sse"), stream_body)
                   .otherwise(resp_stored).alias("_resp"))

    # stage 5: usage (body or stream), price, cost
    s6 = s5.select("*", sse_usage(F.col("_events")).alias("_us"), sse_cache_counts(F.col("_events")).alias("_cs"),
                   body_usage_v(J.parse(resp)).alias("_ub"))
    us, cs = F.col("_us"), F.col("_cs")
    stream_u = F.struct(us["input_tokens"].alias("input_tokens"), us["output_tokens"].alias("output_tokens"),
                        cs["w"].alias("cache_write"), cs["r"].alias("cache_read"), cs["c"].alias("cached"))
    usage = F.when(F.col("_failed"), F.lit(None)).when(F.col("_sse"), stream_u).otherwise(F.col("_ub"))
    s7 = s6.select("*", usage.alias("_u"), price_expr(F.col("_model"), o.overrides).alias("_p"))
    u, p = F.col("_u"), F.col("_p")
    cost = F.when(u["input_tokens"].isNull(), F.lit(None).cast("double")).otherwise(cache_aware_cost(
        u["input_tokens"], u["output_tokens"], p["input_per_mtok"], p["output_per_mtok"],
        u["cache_write"], u["cache_read"], u["cached"]))
    ttft = (F.when(F.col("_failed"), F.lit(None).cast("bigint"))
            .when(F.col("_sse"), ttft_from_chunks(F.col("chunks")))
            .otherwise(F.col("latency_ms")))
    s8 = s7.select("*", J.system_prompt_v(F.col("_reqv")).alias("_sys"))
    out = s8.select(
        F.col("exchange_id").alias("id"),
        F.col("started_at").alias("call_ts"),
        provider_expr(F.col("_upstream")).alias("provider"),
        F.col("_model").alias("model"),
        endpoint_path(F.col("path")).alias("endpoint"),
        F.when(F.col("_failed"), F.lit(0)).otherwise(F.col("status_code")).cast("int").alias("status_code"),
        F.col("latency_ms").cast("bigint").alias("latency_ms"),
        ttft.alias("ttft_ms"),
        u["input_tokens"].alias("input_tokens"),
        u["output_tokens"].alias("output_tokens"),
        cost.alias("cost_usd"),
        F.col("_req").alias("request_body"),
        F.col("_resp").alias("response_body"),
        F.when(F.col("_failed"), F.col("transport_error")).alias("error"),
        F.when(~F.col("_failed"), header("response_headers", "x-request-id")).alias("provider_request_id"),
        F.col("_trace")["trace_id"].alias("trace_id"),
        F.col("_trace")["parent_id"].alias("parent_id"),
        J.fnv1a64_hex(F.col("_sys")).alias("prompt_hash"),
        header("request_headers", "x-trace-tag").alias("tags"),
        header("request_headers", "x-trace-agent").alias("agent_name"),
        header("request_headers", "x-trace-workflow").alias("workflow_id"),
        header("request_headers", "x-trace-span").alias("span_name"),
    )
    return out.select(*CALL_COLUMNS)


def request_info(ex: DataFrame) -> DataFrame:
    """H1 as a table: (exchange_id, model, is_stream)."""
    return ex.select("exchange_id", request_model(F.col("request_body")).alias("model"),
                     request_stream(F.col("request_body")).alias("is_stream"))


def sse_event_rows(ex: DataFrame) -> DataFrame:
    """H3 as a table: one row per parsed stream event ``(exchange_id, pos, event)`` (event as JSON text)."""
    return (ex.where(F.col("chunks").isNotNull())
            .select("exchange_id", F.posexplode(F.transform(
                sse_data_lines(sse_stream_text(F.col("chunks"))), lambda d: d)).alias("pos", "data"))
            .select("exchange_id", "pos", F.to_json(F.try_parse_json("data")).alias("event")))
