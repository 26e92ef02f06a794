import datetime as dt
import json

from pyspark.sql import functions as F

from callscope.functions import jsonx as J
from callscope.operators import enrich as en
from callscope.operators import routing as rt
from callscope.schema import EXCHANGES


def _chunks(spark, *parts):
    df = spark.createDataFrame([([(i * 10, p) for i, p in enumerate(parts)],)],
                               "chunks array<struct<offset_ms:bigint,data:string>>")
    ev = df.select(en.sse_events(F.col("chunks")).alias("e"))
    u = ev.select(en.sse_usage(F.col("e")).alias("u")).first().u
    text = en.with_sse_text(ev, "e", "t").first().t
    return (u.input_tokens, u.output_tokens), text


def test_sse_usage_final_event(spark):
    u, _ = _chunks(spark, 'data: {"choices":[]}\n\n', 'data: {"usage":{"prompt_tokens":100,"completion_tokens":25}}\n\n',
                   "data: [DONE]\n\n")
    assert u == (100, 25)


def test_sse_no_usage(spark):
    assert _chunks(spark, 'data: {"choices":[]}\n\n')[0] == (None, None)
    assert _chunks(spark, "")[0] == (None, None)
    assert _chunks(spark, "data: [DONE]\n\n")[0] == (None, None)


def test_sse_message_start(spark):
    u, _ = _chunks(spark, 'data: {"type":"message_start","message":{"usage":{"input_tokens":100,"output_tokens":1}}}\n\n',
                   'data: {"type":"message_delta","usage":{"output_tokens":25}}\n\n')
    assert u == (100, 25)


def test_sse_split_event(spark):
    u, _ = _chunks(spark, 'data: {"usage":{"prompt_tok', 'ens":7,"completion_tokens":3}}\n\n')
    assert u == (7, 3)


def test_sse_comments_and_event_lines(spark):
    u, _ = _chunks(spark, ": keep-alive\nevent: message\n", 'data: {"usage":{"input_tokens":20,"output_tokens":8}}\n\n')
    assert u == (20, 8)


def test_sse_input_only(spark):
    assert _chunks(spark, 'data: {"usage":{"prompt_tokens":12}}\n\n')[0] == (12, 0)


def test_sse_text(spark):
    _, t = _chunks(spark, 'data: {"choices":[{"delta":{"content":"Hello"}}]}\n\n',
                   'data: {"choices":[{"delta":{"content":" world"}}]}\n\n')
    assert t == "Hello world"


def test_sse_text_wins_over_tools(spark):
    _, t = _chunks(spark, 'data: {"choices":[{"delta":{"content":"Hi"}}]}\n\n',
                   'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"f","arguments":"{}"}}]}}]}\n\n')
    assert t == "Hi"


def test_sse_tool_calls_openai(spark):
    _, t = _chunks(spark,
                   'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"find_tide","arguments":""}}]}}]}\n\n',
                   'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"{\\"harbour\\":"}}]}}]}\n\n',
                   'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"\\"Brest\\"}"}}]}}]}\n\n')
    assert json.loads(t) == [{"name": "find_tide", "arguments": {"harbour": "Brest"}}]


def test_sse_tool_calls_anthropic(spark):
    _, t = _chunks(spark,
                   'data: {"type":"content_block_start","content_block":{"type":"tool_use","name":"find_tide"}}\n\n',
                   'data: {"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"{\\"harbour\\": "}}\n\n',
                   'data: {"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"\\"Hull\\"}"}}\n\n')
    assert json.loads(t) == [{"name": "find_tide", "arguments": {"harbour": "Hull"}}]


def _req(spark, body):
    df = spark.createDataFrame([(body,)], "b string")
    return df.select(en.request_model(F.col("b")).alias("m"), en.request_stream(F.col("b")).alias("s"),
                     en.body_usage(F.col("b")).alias("u")).first()


def test_request_info(spark):
    assert (_req(spark, '{"model":42}').m, _req(spark, '{}').m) == ("unknown", "unknown")
    r = _req(spark, "not json")
    assert (r.m, r.s) == ("unknown", False)
    assert _req(spark, '{"model":"x","stream":"yes"}').s is False
    assert _req(spark, '{"model":"x","stream":true}').s is True


def test_embeddings_usage(spark):
    u = _req(spark, '{"object":"list","data":[],"usage":{"total_tokens":731,"prompt_tokens":731}}').u
    assert (u.input_tokens, u.output_tokens) == (731, 0)


def test_redaction_never_fails_open(spark):
    bodies = ['{"a":1,"a":2,"messages":["secret"]}', '{"messages":["secret"],"messages":["secret2"]}', '{"messages":["secret"', ' [ {"messages": 1} , 2 ] ', '"text"', "12", "null",
              '{"\\u006dessages":["secret"]}', '{"other":1', None, ""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    for allow in ("true", "false"):
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", allow)
        out = {r.i: r.r for r in df.select("i", J.redact(F.col("b"), ["messages"]).alias("r")).collect()}
        assert not any("secret" in (v or "") for v in out.values())
        assert out[3] == '[{"messages":1},2]' and out[4] == '"text"' and out[5] == "12" and out[6] == "null"
        assert out[8] == '{"other":1' and out[9] is None and out[10] == ""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    assert df.where("i = 0").select(J.redact(F.col("b"), ["messages"]).alias("r")).first().r == '{"a":2,"messages":"[REDACTED]"}'


def test_redaction(spark):
    df = spark.createDataFrame([('{"model":"m","messages":[1]}',), ("not json",)], "b string")
    out = [r.r for r in df.select(J.redact(F.col("b"), ["messages"]).alias("r")).collect()]
    assert json.loads(out[0]) == {"model": "m", "messages": "[REDACTED]"}
    assert out[1] == "not json"
    same = df.select(J.redact(F.col("b"), []).alias("r")).collect()
    assert [r.r for r in same] == ['{"model":"m","messages":[1]}', "not json"]


def test_prompt_hash(spark):
    df = spark.createDataFrame([('{"messages":[{"role":"system","content":"Be brief"}]}',),
                                ('{"system":"Be brief"}',), ('{"messages":[]}',), ("a",)], "b string")
    hs = [r.h for r in df.select(J.prompt_hash(F.col("b")).alias("h")).collect()]
    assert hs[0] == hs[1] and len(hs[0]) == 16 and hs[2] is None and hs[3] is None
    assert spark.range(1).select(J.fnv1a64_hex(F.lit("a")).alias("h")).first().h == "af63dc4c8601ec8c"


def test_routes(spark):
    routes = [("/api", "u1"), ("/api/speech", "u2")]
    df = spark.createDataFrame([("/api/speech",), ("/api/speech/live",), ("/api/speeches",), ("/apis",)], "p string")
    out = [r.u for r in df.select(rt.route_expr(F.col("p"), routes, F.lit("dflt")).alias("u")).collect()]
    assert out == ["u1", "u1", "u1", "dflt"]
    only = [("/api/speech", "u2")]
    out = [r.u for r in df.select(rt.route_expr(F.col("p"), only, F.lit("d")).alias("u")).collect()]
    assert out == ["u2", "u2", "d", "d"]
    sh = rt.shadowed_routes(rt.routes_df(spark, routes)).collect()
    assert [(r.path, r.shadowed_by) for r in sh] == [("/api/speech", "/api")]


def test_provider_detection(spark):
    ups = ["https://api.openai.com:443/v1", "https://west-2.openai.azure.com/deploy", "https://bedrock-runtime.eu-central-1.amazonaws.com",
           "http://gateway.internal/openai/v1", "http://127.0.0.1:11434", "https://eu.together.xyz/v1", "https://models.example"]
    df = spark.createDataFrame([(u,) for u in ups], "upstream string")
    a = [r.p for r in df.select(rt.provider_expr(F.col("upstream")).alias("p")).collect()]
    assert a == ["openai", "azure-openai", "bedrock", "openai", "ollama", "together", "unknown"]
    b = {r.upstream: r.provider for r in rt.with_provider(df).collect()}
    assert [b[u] for u in ups] == a


def _ex(spark, **kw):
    base = dict(exchange_id="e1", started_at=dt.datetime(2024, 1, 1), method="POST", path="/v1/chat/completions",
                upstream="https://api.openai.com", request_headers={}, request_body='{"model":"gpt-4o"}',
                status_code=200, response_headers={"content-type": "application/json"}, response_body=None,
                chunks=None, latency_ms=100, transport_error=None)
    base.update(kw)
    return spark.createDataFrame([tuple(base[f.name] for f in EXCHANGES.fields)], EXCHANGES)


def test_e2e_json(spark):
    r = en.enrich_calls(_ex(spark, response_body='{"usage":{"prompt_tokens":10,"completion_tokens":5}}',
                            response_headers={"content-type": "application/json", "x-request-id": "req-1"})).first()
    assert (r.status_code, r.input_tokens, r.output_tokens, r.error, r.ttft_ms) == (200, 10, 5, None, 100)
    assert r.provider == "openai" and r.provider_request_id == "req-1"
    assert r.cost_usd == (10 * 2.5 + 5 * 10.0) / 1e6


def test_e2e_sse(spark):
    chunks = [(20, 'data: {"choices":[{"delta":{"content":"Hi"}}]}\n\n'),
              (30, 'data: {"choices":[],"usage":{"prompt_tokens":8,"completion_tokens":3}}\n\ndata: [DONE]\n\n')]
    r = en.enrich_calls(_ex(spark, request_body='{"model":"gpt-4o","stream":true}', chunks=chunks,
                            response_headers={"content-type": "text/event-stream"})).first()
    assert (r.status_code, r.input_tokens, r.output_tokens) == (200, 8, 3)
    assert "Hi" in r.response_body and r.ttft_ms <= r.latency_ms


def test_e2e_upstream_error_and_failure(spark):
    r = en.enrich_calls(_ex(spark, status_code=500, response_body='{"error":"x"}')).first()
    assert r.status_code == 500
    r = en.enrich_calls(_ex(spark, status_code=0, transport_error="connection refused",
                            response_headers=None)).first()
    assert (r.status_code, r.error, r.input_tokens, r.ttft_ms) == (0, "connection refused", None, None)


def test_e2e_embeddings(spark):
    r = en.enrich_calls(_ex(spark, path="/v1/embeddings?x=1", request_body='{"model":"text-embedding-3-small"}',
                            response_body='{"object":"list","usage":{"total_tokens":12,"prompt_tokens":12}}')).first()
    assert (r.input_tokens, r.output_tokens, r.endpoint) == (12, 0, "/v1/embeddings")


def test_e2e_trace_headers(spark):
    tp = "00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01"
    r = en.enrich_calls(_ex(spark, request_headers={"traceparent": tp, "x-trace-agent": "planner"})).first()
    assert (r.trace_id, r.parent_id, r.agent_name) == ("4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7", "planner")
    r = en.enrich_calls(_ex(spark, request_headers={"x-b3-traceid": "t", "x-b3-parentspanid": "p"})).first()
    assert (r.trace_id, r.parent_id) == ("t", "p")
    r = en.enrich_calls(_ex(spark)).first()
    assert (r.trace_id, r.parent_id) == (None, None)


def test_e2e_non_llm_dropped_and_limits(spark):
    assert en.enrich_calls(_ex(spark, request_body="", response_body="{}")).count() == 0
    lim = en.Limits(max_stored_response=10)
    r = en.enrich_calls(_ex(spark, response_body='{"usage":{"prompt_tokens":1}}'),
                        en.EnrichOptions(limits=lim)).first()
    assert r.response_body.startswith("[body of ") and r.input_tokens == 1
    big = [(10, 'data: {"usage":{"prompt_tokens":4}}\n\n'), (20, "data: " + "x" * 100 + "\n\n")]
    r = en.enrich_calls(_ex(spark, request_body='{"model":"gpt-4o","stream":true}', chunks=big,
                            response_headers={"content-type": "text/event-stream"}),
                        en.EnrichOptions(limits=en.Limits(max_accumulation=60))).first()
    assert r.response_body.startswith("[stream left out") and r.input_tokens == 4
    whole = en.enrich_calls(_ex(spark, response_body=json.dumps({"usage": {"prompt_tokens": 2}, "pad": "x" * 11_000_000}))).first()
    assert len(whole.response_body) > 11_000_000 and whole.input_tokens == 2  # no limit unless a caller sets one
