from callscope.functions.predicates import error_class
from callscope.operators.checks import rule_check


def _rules(spark, make_calls, rows, rules):
    return {r.rule: r.status for r in rule_check(make_calls(rows), rules).collect()}


def test_rule_latency(spark, make_calls):
    rows = [dict(id=f"c{i}", latency_ms=1500) for i in range(10)]
    out = _rules(spark, make_calls, rows, ["latency_p99 < 1800", "latency_p99 < 1400"])
    assert out == {"latency_p99 < 1800": "PASS", "latency_p99 < 1400": "FAIL"}


def test_rule_error_rate(spark, make_calls):
    rows = [dict(id=f"c{i}", status_code=500 if i < 3 else 200) for i in range(100)]
    out = _rules(spark, make_calls, rows, ["error_rate < 0.04", "error_rate < 0.02"])
    assert out == {"error_rate < 0.04": "PASS", "error_rate < 0.02": "FAIL"}


def test_rule_errors(spark, make_calls):
    out = rule_check(make_calls([dict()]), ["median_cost < 3", "norule", "total_calls = 1"]).collect()
    st = {r.rule: r.status for r in out}
    assert st == {"median_cost < 3": "ERR", "norule": "ERR", "total_calls = 1": "PASS"}
    assert all(r.job_failed for r in out)


def test_error_classes(spark, make_calls):
    rows = [dict(id="a", status_code=429), dict(id="b", status_code=401), dict(id="c", status_code=403),
            dict(id="d", status_code=503), dict(id="e", status_code=0, error="request timed out"),
            dict(id="f", status_code=0, error="connection refused"), dict(id="g", status_code=200)]
    out = {r.id: r.c for r in make_calls(rows).select("id", error_class().alias("c")).collect()}
    assert out == {"a": "rate_limit", "b": "auth", "c": "auth", "d": "upstream_5xx", "e": "timeout",
                   "f": "connection", "g": None}
