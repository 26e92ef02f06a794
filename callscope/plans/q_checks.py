"""Registered rule and budget checks."""

from __future__ import annotations

from callscope.operators.checks import budget_gate, rule_check
from callscope.plans.catalog import calls, register

RULES = ["latency_p99 < 60000", "error_rate < 0.05", "error_count >= 1", "avg_cost_usd <= 0.001",
         "total_calls == 10000", "median_cost < 3", "no rule at all here?", "error_rate ~ 0.1",
         "latency_p99 < abc", "  total_calls > 5  "]

_STATS = """SELECT count(*)::DOUBLE AS total_calls,
  count(CASE WHEN error IS NOT NULL OR status_code >= 400 THEN 1 END)::DOUBLE AS error_count,
  CASE WHEN count(*) > 0 THEN count(CASE WHEN error IS NOT NULL OR status_code >= 400 THEN 1 END) / count(*) ELSE 0.0 END
    AS error_rate,
  coalesce(list_sort(list(latency_ms))[least(count(latency_ms)*99//100, count(latency_ms)-1)+1], 0)::DOUBLE AS latency_p99,
  coalesce(avg(cost_usd), 0.0) AS avg_cost_usd FROM calls"""


def _rules_sql() -> str:
    vals = ", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES))
    pat = "^([^ ]*) ([^ ]*) (.*)$"
    return f"""WITH s AS ({_STATS}),
  m AS (UNPIVOT s ON total_calls, error_count, error_rate, latency_p99, avg_cost_usd INTO NAME metric VALUE lhs),
  r AS (SELECT pos, rule, regexp_matches(trim(rule), '{pat}') AS shape,
          regexp_extract(trim(rule), '{pat}', 1) AS metric, regexp_extract(trim(rule), '{pat}', 2) AS op,
          TRY_CAST(regexp_extract(trim(rule), '{pat}', 3) AS DOUBLE) AS rhs
        FROM (VALUES {vals}) t(pos, rule)),
  j AS (SELECT r.*, m.lhs FROM r LEFT JOIN m USING (metric)),
  o AS (SELECT pos, rule,
    CASE WHEN NOT (shape AND rhs IS NOT NULL AND lhs IS NOT NULL AND op IN ('<','<=','>','>=','=','=='))
         THEN 'ERR'
         WHEN CASE op WHEN '<' THEN lhs < rhs WHEN '<=' THEN lhs <= rhs WHEN '>' THEN lhs > rhs
                      WHEN '>=' THEN lhs >= rhs ELSE abs(lhs - rhs) < 2.220446049250313e-16 END THEN 'PASS'
         ELSE 'FAIL' END AS status, metric, op, round(lhs, 9) AS lhs, round(rhs, 9) AS rhs FROM j)
  SELECT *, max(CASE WHEN status <> 'PASS' THEN 1 ELSE 0 END) OVER () = 1 AS job_failed FROM o"""


@register("rule_check", _rules_sql())
def q_rule_check(spark, sf):
    """PASS/FAIL/ERR per rule against eval stats; job fails when any rule does not pass."""
    return rule_check(calls(spark, sf), RULES)


@register("budget_gate", """SELECT round(coalesce(sum(cost_usd), 0.0), 9) AS total_cost_usd, count(*) AS total_calls,
  40.0::DOUBLE AS limit_usd, coalesce(sum(cost_usd), 0.0) > 40.0 AS failed FROM calls""")
def q_budget_gate(spark, sf):
    """Total cost against a 40 USD threshold."""
    return budget_gate(calls(spark, sf), 40.0)
