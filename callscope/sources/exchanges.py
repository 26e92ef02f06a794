"""Raw exchange log: schema-driven reader and a stand-in built from ``conversations``.

``load_exchanges`` reads a captured exchange log (parquet or JSON lines)
with the fixed EXCHANGES schema (A3).

``exchanges_view`` shapes the driver's ``conversations`` table into that
schema so the enrichment job has wire-level input: every assistant turn is
one exchange whose request carries the conversation's system prompt and the
preceding turn, and whose response (a JSON body or a list of server-sent
event chunks) carries the assistant text and a usage block. Variation
(dialect, streaming, tool calls, cache counts, failures, headers) is chosen
by fixed rules on ``conv_id`` / ``turn``. The builder only writes wire
payloads; parsing them is entirely the enrichment job's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schema import EXCHANGES
from callscope.sources.fixtures import read_table

# Stand-in variation tables (model, upstream) by conv_id % 6.
_KINDS = [
    ("gpt-4o", "https://api.openai.com"),
    ("claude-3-5-sonnet-20241022", "https://api.anthropic.com"),
    ("gemini-2.5-pro", "https://generativelanguage.googleapis.com/v1beta/openai"),
    ("llama-3.1-70b", "https://api.groq.com/openai"),
    ("gpt-4o-mini", "https://myres.openai.azure.com"),
    ("mystery-model-x", "http://localhost:11434"),
]
_AGENTS = ["planner", "researcher", "writer"]
CHUNK_CHARS = 64


def load_exchanges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A3: read an exchange log with the fixed schema (absent columns become typed NULLs)."""
    return spark.read.schema(EXCHANGES).format(fmt).load(path)


def _pick(idx: Column, values: list[str]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def _sse(events: Column) -> Column:
    """Events (already formatted lines) -> one SSE stream text."""
    return F.concat(F.array_join(events, "\n\n"), F.lit("\n\n"))


def exchanges_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    sys_ = (conv.where(F.col("role") == "system").groupBy("conv_id")
            .agg(F.min_by("text", "turn").alias("sys_text")))
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"),
                       F.col("role").alias("prev_role"), F.col("text").alias("prev_text"))
    a = (conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
         .join(prev, ["conv_id", "turn"], "left").join(sys_, "conv_id", "left"))

    cid, turn = F.col("conv_id"), F.col("turn")
    kind = F.pmod(cid, F.lit(6))
    model = _pick(kind, [k[0] for k in _KINDS])
    upstream = _pick(kind, [k[1] for k in _KINDS])
    anthropic = kind == 1
    stream = F.pmod(turn, F.lit(4)) == 3
    failed = F.pmod(cid, F.lit(23)) == 9
    limited = (F.pmod(cid, F.lit(13)) == 4) & ~stream & ~failed
    tools = (F.pmod(cid, F.lit(7)) == 3) & stream
    non_llm = (F.pmod(cid, F.lit(29)) == 0) & (turn == 1)
    prev_text = F.coalesce(F.col("prev_text"), F.lit(""))
    sys_text = F.col("sys_text")
    n_in = (F.lit(10) + F.floor((F.length(prev_text) + F.coalesce(F.length(sys_text), F.lit(0))) / 4)).cast("long")
    n_out = (F.lit(1) + F.floor(F.length("answer") / 4)).cast("long")
    cached = F.when(F.pmod(cid, F.lit(5)) == 0, F.floor(n_in / 2).cast("long")).otherwise(F.lit(0).cast("long"))
    cache_write = F.when(F.pmod(cid, F.lit(5)) == 1, F.floor(n_in / 3).cast("long")).otherwise(F.lit(0).cast("long"))

    # ---- request body (model may be missing or non-string by rule)
    user_msg = F.struct(F.coalesce(F.when(F.col("prev_role") == "assistant", "assistant"), F.lit("user")).alias("role"),
                        prev_text.alias("content"))
    sys_msg = F.when(sys_text.isNotNull(), F.struct(F.lit("system").alias("role"), sys_text.alias("content")))
    oai_req = F.to_json(F.struct(model.alias("model"), F.array_compact(F.array(sys_msg, user_msg)).alias("messages"),
                                 stream.alias("stream")))
    ant_req = F.to_json(F.struct(model.alias("model"), sys_text.alias("system"), F.array(user_msg).alias("messages"),
                                 F.lit(1024).alias("max_tokens"), stream.alias("stream")))
    req = F.when(anthropic, ant_req).otherwise(oai_req)
    req = (F.when(F.pmod(cid, F.lit(17)) == 5, F.regexp_replace(req, r'"model":"[^"]*",', ""))
           .when(F.pmod(cid, F.lit(19)) == 7, F.regexp_replace(req, r'"model":"[^"]*"', '"model":42'))
           .otherwise(req))
    req = F.when(non_llm, F.lit("")).otherwise(req)

    # ---- buffered response bodies
    oai_usage = F.struct(n_in.alias("prompt_tokens"), n_out.alias("completion_tokens"),
                         F.struct(cached.alias("cached_tokens")).alias("prompt_tokens_details"))
    ant_usage = F.struct(n_in.alias("input_tokens"), n_out.alias("output_tokens"),
                         cached.alias("cache_read_input_tokens"), cache_write.alias("cache_creation_input_tokens"))
    oai_body = F.to_json(F.struct(
        F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"),
                                                           F.col("answer").alias("content")).alias("message"))
                ).alias("choices"), oai_usage.alias("usage")))
    ant_body = F.to_json(F.struct(
        F.array(F.struct(F.lit("text").alias("type"), F.col("answer").alias("text"))).alias("content"),
        ant_usage.alias("usage")))
    body = (F.when(non_llm, F.lit('{"data":[]}'))
            .when(limited, F.lit('{"error":{"message":"Rate limit exceeded"}}'))
            .when(anthropic, ant_body).otherwise(oai_body))

    # ---- streamed responses: events -> SSE text -> fixed-size chunks
    pieces = F.regexp_extract_all(F.col("answer"), F.lit("(?s).{1,40}"), 0)
    data = lambda s: F.concat(F.lit("data: "), s)
    oai_text_ev = F.transform(pieces, lambda p: data(F.to_json(F.struct(F.array(F.struct(
        F.lit(0).alias("index"), F.struct(p.alias("content")).alias("delta"))).alias("choices")))))
    oai_tool_ev = F.array(
        data(F.lit('{"choices":[{"index":0,"delta":{"tool_calls":[{"index":0,"function":'
                   '{"name":"find_tide","arguments":""}}]}}]}')),
        data(F.lit('{"choices":[{"index":0,"delta":{"tool_calls":[{"index":0,"function":{"arguments":"{\\"harbour\\":"}}]}}]}')),
        data(F.concat(F.lit('{"choices":[{"index":0,"delta":{"tool_calls":[{"index":0,"function":{"arguments":'
                            '" \\"C'), cid.cast("string"), F.lit('\\"}"}}]}}]}'))))
    oai_tail = F.array(data(F.to_json(F.struct(F.array().cast("array<int>").alias("choices"),
                                               oai_usage.alias("usage")))), F.lit("data: [DONE]"))
    oai_ev = F.concat(F.when(tools, oai_tool_ev).otherwise(oai_text_ev), oai_tail)
    ant_start = F.concat(F.lit("event: message_start\n"), data(F.to_json(F.struct(
        F.lit("message_start").alias("type"),
        F.struct(F.struct(n_in.alias("input_tokens"), F.lit(1).alias("output_tokens"),
                          cached.alias("cache_read_input_tokens"),
                          cache_write.alias("cache_creation_input_tokens")).alias("usage")).alias("message")))))
    ant_text_ev = F.transform(pieces, lambda p: data(F.to_json(F.struct(
        F.lit("content_block_delta").alias("type"),
        F.struct(F.lit("text_delta").alias("type"), p.alias("text")).alias("delta")))))
    ant_tool_ev = F.array(
        data(F.lit('{"type":"content_block_start","index":0,"content_block":{"type":"tool_use","name":"find_tide"}}')),
        data(F.lit('{"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"{\\"harbour\\":"}}')),
        data(F.concat(F.lit('{"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":" \\"C'),
                      cid.cast("string"), F.lit('\\"}"}}'))))
    ant_tail = F.array(
        data(F.to_json(F.struct(F.lit("message_delta").alias("type"),
                                F.struct(n_out.alias("output_tokens")).alias("usage")))),
        F.concat(F.lit("event: message_stop\n"), data(F.lit('{"type":"message_stop"}'))))
    ant_ev = F.concat(F.array(ant_start), F.when(tools, ant_tool_ev).otherwise(ant_text_ev), ant_tail)
    events = F.when(anthropic, ant_ev).otherwise(oai_ev)
    events = F.when(F.pmod(cid, F.lit(2)) == 0, F.concat(F.array(F.lit(": keep-alive")), events)).otherwise(events)
    # the text is a column of its own, built once a row, and cut in one pass
    a = a.withColumn("_sse_text", _sse(events))
    sse_text = F.col("_sse_text")
    n_chunks = F.ceil(F.length(sse_text) / CHUNK_CHARS).cast("int")
    chunks = F.transform(F.regexp_extract_all(sse_text, F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0)), lambda data, i: F.struct(
        (F.lit(30) + i * 7).cast("long").alias("offset_ms"), data.alias("data")))
    chunks = F.when(F.pmod(cid, F.lit(4)) == 2, F.concat(
        F.array(F.struct(F.lit(5).cast("long").alias("offset_ms"), F.lit("").alias("data"))), chunks)).otherwise(chunks)

    # ---- headers
    h = F.md5(cid.cast("string"))
    span = F.substring(F.md5(F.concat(cid.cast("string"), F.lit("/"), turn.cast("string"))), 1, 16)
    kv = F.array(
        F.struct(F.lit("content-type").alias("k"), F.lit("application/json").alias("v")),
        F.struct(F.lit("traceparent").alias("k"), F.when(F.pmod(cid, F.lit(3)) == 0, F.concat(
            F.lit("00-"), h, F.lit("-"), span, F.lit("-01"))).alias("v")),
        F.struct(F.lit("x-trace-id").alias("k"), F.when(F.pmod(cid, F.lit(3)) == 1,
                                                        F.concat(F.lit("trace-"), cid.cast("string"))).alias("v")),
        F.struct(F.lit("x-parent-span-id").alias("k"), F.when((F.pmod(cid, F.lit(3)) == 1) & (turn > 1),
                                                              F.concat(F.lit("span-"), (turn - 2).cast("string"))).alias("v")),
        F.struct(F.lit("x-b3-traceid").alias("k"), F.when(F.pmod(cid, F.lit(3)) == 2, h).alias("v")),
        F.struct(F.lit("x-trace-agent").alias("k"), _pick(F.pmod(turn, F.lit(4)), _AGENTS).alias("v")),
        F.struct(F.lit("x-trace-workflow").alias("k"), F.when(F.pmod(cid, F.lit(4)) != 0, F.concat(
            F.lit("wf-"), F.pmod(cid, F.lit(10)).cast("string"))).alias("v")),
        F.struct(F.lit("x-trace-tag").alias("k"), F.when(F.pmod(cid, F.lit(10)) == 1, F.lit("exp-a")).alias("v")),
        F.struct(F.lit("x-trace-span").alias("k"), F.concat(F.lit("turn-"), turn.cast("string")).alias("v")),
    )
    req_headers = F.map_from_entries(F.filter(kv, lambda x: x["v"].isNotNull()))
    ctype = F.when(stream, F.lit("text/event-stream; charset=utf-8")).otherwise(F.lit("application/json"))
    resp_headers = F.create_map(F.lit("content-type"), ctype, F.lit("x-request-id"),
                                F.concat(F.lit("req_"), cid.cast("string"), F.lit("_"), turn.cast("string")))
    path = (F.when(non_llm, F.lit("/v1/models")).when(anthropic, F.lit("/v1/messages"))
            .when(kind == 4, F.lit("/v1/chat/completions?api-version=2024-06-01"))
            .otherwise(F.lit("/v1/chat/completions")))
    started = (F.lit("2024-01-01 00:00:00").cast("timestamp")
               + F.make_dt_interval(F.lit(0), F.lit(0), (cid * 10).cast("int"), turn * 7))
    latency = F.greatest(F.lit(120) + F.length("answer"), F.lit(40) + n_chunks * 7).cast("long")
    use_stream = stream & ~failed & ~non_llm
    return a.select(
        F.concat(F.lpad(cid.cast("string"), 6, "0"), F.lit("-"), F.lpad(turn.cast("string"), 3, "0"))
        .alias("exchange_id"),
        started.alias("started_at"),
        F.when(non_llm, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        path.alias("path"),
        upstream.alias("upstream"),
        req_headers.alias("request_headers"),
        req.alias("request_body"),
        F.when(failed, F.lit(0)).when(limited, F.lit(429)).otherwise(F.lit(200)).cast("int").alias("status_code"),
        F.when(failed, F.lit(None)).otherwise(resp_headers).alias("response_headers"),
        F.when(failed | use_stream, F.lit(None).cast("string")).otherwise(body).alias("response_body"),
        F.when(use_stream, chunks).alias("chunks"),
        latency.alias("latency_ms"),
        F.when(failed, F.when(F.pmod(turn, F.lit(2)) == 0, F.lit("connection refused"))
               .otherwise(F.lit("operation timed out"))).alias("transport_error"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in EXCHANGES.fields])
