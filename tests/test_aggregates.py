import datetime as dt

import pytest

from callscope.functions.predicates import CallFilter, parse_since, parse_status_range, parse_until
from callscope.operators import aggregates as ag
from callscope.operators import metrics as mt
from callscope.operators import percentiles as pc


def test_percentiles_1_to_100(spark, make_calls):
    df = make_calls([dict(id=f"c{i}", latency_ms=i) for i in range(1, 101)])
    r = pc.latency_percentiles(df).first()
    assert (r.p50, r.p95, r.p99) == (51, 96, 100)


def test_percentiles_single_and_empty(spark, make_calls):
    r = pc.latency_percentiles(make_calls([dict(latency_ms=500)])).first()
    assert (r.p50, r.p95, r.p99) == (500, 500, 500)
    empty = make_calls([dict(latency_ms=500)]).where("false")
    r = pc.latency_percentiles(empty).first()
    assert (r.p50, r.p95, r.p99) == (0, 0, 0)


def test_percentiles_by_model(spark, make_calls):
    rows = [dict(id=f"a{i}", model="a", latency_ms=100 * i) for i in range(1, 11)]
    rows += [dict(id=f"b{i}", model="b", latency_ms=50 * i) for i in range(1, 11)]
    out = {r.model: r.p99 for r in pc.latency_percentiles_by_model(make_calls(rows)).collect()}
    assert out == {"a": 1000, "b": 500}


def test_token_percentiles(spark, make_calls):
    rows = [dict(id=f"c{i}", input_tokens=v) for i, v in enumerate([100, 200, 300])]
    assert pc.token_percentiles(make_calls(rows)).first().input_p50 == 200


def test_stats_golden(spark, make_calls):
    df = make_calls([
        dict(id="a", input_tokens=100, output_tokens=50, cost_usd=0.001, latency_ms=100),
        dict(id="b", input_tokens=200, output_tokens=100, cost_usd=0.002, latency_ms=300),
        dict(id="c", status_code=500, error="boom"),
    ])
    r = ag.stats(df, as_of="2024-01-01T12:30:00").first()
    assert r.total_calls == 3 and r.total_input_tokens == 400 and r.total_output_tokens == 200
    assert r.total_cost_usd == pytest.approx(0.004)
    assert r.avg_latency_ms == pytest.approx(173.333333, rel=1e-6)
    assert r.error_count == 1 and r.calls_last_hour == 3


def test_cost_since_golden(spark, make_calls):
    now = dt.datetime(2024, 6, 1)
    rows = [dict(id=f"n{i}", call_ts=now, cost_usd=1.0) for i in range(3)]
    rows.append(dict(id="old", call_ts=dt.datetime(2020, 1, 1), cost_usd=999.0))
    assert ag.cost_since(make_calls(rows), "2024-01-01").first().cost == pytest.approx(3.0)


def test_workflow_summary_golden(spark, make_calls):
    t = dt.datetime(2024, 1, 1)
    rows = [
        dict(id="1", workflow_id="wf-1", agent_name="planner", latency_ms=200, call_ts=t),
        dict(id="2", workflow_id="wf-1", agent_name="coder", latency_ms=500, status_code=500, error="x",
             call_ts=t + dt.timedelta(seconds=1)),
        dict(id="3", workflow_id="wf-2", agent_name="planner", call_ts=t + dt.timedelta(hours=1)),
        dict(id="4", workflow_id=None, call_ts=t),
    ]
    out = ag.workflow_summary(make_calls(rows)).collect()
    assert [r.workflow_id for r in out] == ["wf-2", "wf-1"]
    wf1 = out[1]
    assert (wf1.calls, wf1.agents, wf1.error_count, wf1.total_latency_ms) == (2, 2, 1, 700)


def test_compare_models_golden(spark, make_calls):
    rows = [dict(id="a1", model="A", cost_usd=0.004), dict(id="a2", model="A", cost_usd=0.002),
            dict(id="b1", model="B", cost_usd=0.003)]
    out = {r.model: r for r in ag.compare_models(make_calls(rows), "A", "B").collect()}
    assert out["A"].total_cost_usd == pytest.approx(0.006)
    assert out["B"].total_cost_usd == pytest.approx(0.003)
    missing = ag.compare_models(make_calls(rows), "A", "Z").collect()[1]
    assert missing.calls == 0 and missing.latency_p99 == 0


def test_histogram_golden(spark, make_calls):
    df = make_calls([dict(id="a", latency_ms=50), dict(id="b", latency_ms=300)])
    rows = {r.le: r for r in mt.metric_latency_hist(df).collect()}
    assert rows["100"].n == 1 and rows["500"].n == 2 and rows["+Inf"].n == 2
    assert rows["+Inf"]["count"] == 2 and rows["+Inf"]["sum"] == 350


def test_status_range_parse():
    assert parse_status_range("400-499") == (400, 499)
    with pytest.raises(ValueError):
        parse_status_range("500-400")
    with pytest.raises(ValueError):
        parse_status_range("abc")


def test_time_bounds():
    assert parse_since("2024-02-22") == dt.datetime(2024, 2, 22)
    assert parse_until("2024-02-22") == dt.datetime(2024, 2, 22, 23, 59, 59, 999000)


def test_filter_exact_status_wins(spark, make_calls):
    df = make_calls([dict(id="a", status_code=429), dict(id="b", status_code=500)])
    f = CallFilter(status=429, status_range="500-599")
    assert [r.id for r in f.apply(df).collect()] == ["a"]


def test_agent_literal_underscore(spark, make_calls):
    df = make_calls([dict(id="a", agent_name="coder_x"), dict(id="b", agent_name="coderzx"),
                     dict(id="c", agent_name=None)])
    assert [r.id for r in CallFilter(agent="r_x").apply(df).collect()] == ["a"]
