"""Registered order-dependent analytics."""

from __future__ import annotations

from callscope.operators import workflows as wf
from callscope.operators.calendar import calendar_fill, heat_intensity
from callscope.plans.catalog import AS_OF, calls, register
from callscope.plans.q_joins import _CAL_SQL


@register("running_cost", """SELECT id, call_ts, model, round(coalesce(cost_usd, 0.0), 9) AS cost_usd,
  round(sum(coalesce(cost_usd, 0.0)) OVER (ORDER BY call_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9)
    AS cum_cost FROM calls""")
def q_running_cost(spark, sf):
    """cumulative cost in time order (range-partitioned, offset-added)."""
    return wf.running_cost(calls(spark, sf))


@register("workflow_gantt", """WITH b AS (SELECT workflow_id, id, call_ts, latency_ms, (epoch_us(call_ts) // 1000) AS t0,
    (epoch_us(call_ts) // 1000) + coalesce(latency_ms, 0) AS t1 FROM calls WHERE workflow_id IS NOT NULL),
  s AS (SELECT workflow_id, min(t0) AS mn, CASE WHEN max(t1) - min(t0) = 0 THEN 1 ELSE max(t1) - min(t0) END AS span
        FROM b GROUP BY workflow_id)
  SELECT workflow_id, id, call_ts, latency_ms, round((t0 - mn) / span * 100.0, 9) AS left_pct,
    round(greatest(coalesce(latency_ms, 0) / span * 100.0, 1.0), 9) AS width_pct FROM b JOIN s USING (workflow_id)""")
def q_workflow_gantt(spark, sf):
    """per-call offset/width within every workflow's time span."""
    return wf.workflow_gantt(calls(spark, sf))


@register("heat_intensity", f"""SELECT date, calls, round(cost_usd, 9) AS cost_usd, error_count,
  round(CASE WHEN max(cost_usd) OVER () > 0 THEN cost_usd / max(cost_usd) OVER () ELSE 0.0 END, 9) AS intensity,
  error_count > 0 AS has_error FROM ({_CAL_SQL})""")
def q_heat_intensity(spark, sf):
    """day cost relative to the most expensive day of a 45-day calendar."""
    return heat_intensity(calendar_fill(calls(spark, sf), 45, AS_OF))
