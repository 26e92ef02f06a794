import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from callscope.functions.predicates import CallFilter
from callscope.operators import aggregates as ag
from callscope.operators import metrics as mt
from callscope.operators.calendar import calendar_fill, heat_intensity
from callscope.sources import exports as ex


def test_truncate_bytes_at_char_boundary(spark):
    s = "é" * 6000  # 12 000 bytes, 2 bytes per char
    out = spark.createDataFrame([(s,), ("short",)], "s string").select(ex.truncate_bytes(F.col("s"), 10_240).alias("t"))
    t = [r.t for r in out.collect()]
    assert t[0] == "é" * 5120 and len(t[0].encode()) == 10_240
    assert t[1] == "short"
    odd = spark.createDataFrame([("a" + "é" * 10,)], "s string").select(ex.truncate_bytes(F.col("s"), 4).alias("t"))
    assert odd.first().t == "aé"


def test_csv_quoting(spark, make_calls):
    df = make_calls([dict(id="a", error='bad, "quoted"\nline'), dict(id="b", cost_usd=None, ttft_ms=None)])
    lines = {r.id: r.line for r in ex.csv_lines(df).collect()}
    assert lines["a"].endswith(',"bad, ""quoted""\nline",')
    fields = lines["b"].split(",")
    assert fields[7] == "" and fields[10] == ""
    assert ex.csv_fields(df).where("id = 'a'").first().cost_usd == "0.00100000"


def test_jsonl_keeps_nulls_and_fields(spark, make_calls):
    line = ex.jsonl(make_calls([dict()])).first().line
    obj = json.loads(line)
    assert len(obj) == 22 and obj["timestamp"] == "2024-01-01T12:00:00.000Z" and obj["error"] is None


def test_langfuse_and_weave_shapes(spark, make_calls):
    df = make_calls([dict(workflow_id="wf-1", error="boom", input_tokens=3, output_tokens=None)])
    lf = json.loads(ex.langfuse(df).first().line)["batch"][0]
    assert lf["type"] == "generation-create" and lf["body"]["traceId"] == "wf-1"
    assert lf["body"]["level"] == "ERROR" and lf["body"]["usage"].get("total") is None
    assert lf["body"]["input"] == {"model": "gpt-4o"}
    wv = json.loads(ex.weave(df).first().line)["calls"][0]
    assert wv["summary"]["usage"]["gpt-4o"] == {"prompt_tokens": 3, "completion_tokens": 0,
                                                "total_tokens": 3, "requests": 1}


def test_otlp_status_and_events(spark, make_calls):
    df = make_calls([dict(status_code=0, error="connection refused", endpoint="/v1/embeddings", span_name=None)])
    span = json.loads(ex.otlp_spans(df).first().line)["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    assert span["status"] == {"code": 2, "message": "connection refused"}
    assert span["name"] == "embeddings gpt-4o" and span["events"][0]["name"] == "exception"
    keys = [a["key"] for a in span["attributes"]]
    assert "error.type" in keys and "gen_ai.agent.name" not in keys


def test_report_json(spark, make_calls):
    df = make_calls([dict(id="a", model="m1", cost_usd=1.0), dict(id="b", model="m2", cost_usd=3.0),
                     dict(id="c", model="m2", cost_usd=None)])
    doc = json.loads(ex.report_json(ag.cost_report(df, CallFilter())).first().document)
    assert doc["total_calls"] == 3 and doc["total_cost_usd"] == pytest.approx(4.0)
    assert [m["model"] for m in doc["models"]] == ["m2", "m1"]


def test_calendar_zero_fill(spark, make_calls):
    df = make_calls([dict(id="a", call_ts=dt.datetime(2024, 1, 30, 5), cost_usd=2.0, status_code=500),
                     dict(id="b", call_ts=dt.datetime(2024, 1, 28, 5), cost_usd=1.0)])
    cal = calendar_fill(df, 5, "2024-01-31T00:00:00").collect()
    assert [str(r.date) for r in cal] == ["2024-01-27", "2024-01-28", "2024-01-29", "2024-01-30", "2024-01-31"]
    assert [r.calls for r in cal] == [0, 1, 0, 1, 0]
    heat = {str(r.date): (r.intensity, r.has_error) for r in heat_intensity(calendar_fill(df, 5, "2024-01-31")).collect()}
    assert heat["2024-01-30"] == (1.0, True) and heat["2024-01-28"] == (0.5, False)


def test_budget_periods(spark, make_calls):
    assert mt.period_start("week", "2024-01-31T10:00:00") == dt.datetime(2024, 1, 29)
    assert mt.period_start("day", "2024-01-31T10:00:00") == dt.datetime(2024, 1, 31)
    assert mt.period_start("quarter", "2024-01-31T10:00:00") == dt.datetime(2024, 1, 1)
    df = make_calls([dict(id="a", call_ts=dt.datetime(2024, 1, 30), cost_usd=4.5)])
    r = mt.metric_budget(df, 5.0, "week", "2024-01-31T00:00:00").first()
    assert (r.pct, r.near_limit, r.over_limit) == (90, True, False)


def test_exposition_order(spark, make_calls):
    df = make_calls([dict(id="a", latency_ms=50, agent_name="x"), dict(id="b", latency_ms=300)])
    lines = [r.line for r in mt.metrics_exposition(df).orderBy("family", "seq", "k").collect()]
    assert lines[0] == "# HELP callscope_calls_total Calls in the table, by model, provider and status class"
    assert 'callscope_latency_ms_bucket{model="gpt-4o",le="100"} 1' in lines
    i = lines.index('callscope_latency_ms_bucket{model="gpt-4o",le="+Inf"} 2')
    assert lines[i + 1] == 'callscope_latency_ms_sum{model="gpt-4o"} 350'
    assert lines[i + 2] == 'callscope_latency_ms_count{model="gpt-4o"} 2'
