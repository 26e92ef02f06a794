"""Registered aggregate and percentile queries."""

from __future__ import annotations

from callscope.functions.predicates import CallFilter
from callscope.operators import aggregates as ag
from callscope.operators import percentiles as pc
from callscope.plans.catalog import AS_OF, calls, register

ERR_A = "(error IS NOT NULL OR status_code >= 400 OR status_code = 0)"
ERR_B = "(error IS NOT NULL OR status_code >= 400)"


def pct(col: str, p: int) -> str:
    """DuckDB text of the exact rank percentile sorted[min(n*p div 100, n-1)]."""
    return f"list_sort(list({col}))[least(count({col})*{p}//100, count({col})-1)+1]"


_BY = """SELECT {key}, count(*) AS calls, {tok} round(coalesce(sum(cost_usd), 0.0), 9) AS total_cost_usd,
  round(coalesce(avg(latency_ms), 0.0), 9) AS avg_latency_ms,
  count(CASE WHEN {err} THEN 1 END) AS error_count FROM calls {where} GROUP BY {key}"""
_TOK = ("CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens, "
        "CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,")


@register("total_calls", "SELECT count(*) AS n FROM calls")
def q_total_calls(spark, sf):
    """Number of calls."""
    return ag.total_calls(calls(spark, sf))


@register("stats", f"""SELECT count(*) AS total_calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens, round(coalesce(sum(cost_usd), 0.0), 9) AS total_cost_usd,
  round(coalesce(avg(latency_ms), 0.0), 9) AS avg_latency_ms, count(CASE WHEN {ERR_A} THEN 1 END) AS error_count,
  count(CASE WHEN call_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 1 END) AS calls_last_hour FROM calls""")
def q_stats(spark, sf):
    """Global totals in one aggregate."""
    return ag.stats(calls(spark, sf), as_of=AS_OF)


@register("error_rate", f"""SELECT count(*) AS total_calls, count(CASE WHEN {ERR_A} THEN 1 END) AS error_count,
  round(CASE WHEN count(*) > 0 THEN count(CASE WHEN {ERR_A} THEN 1 END) / count(*) ELSE 0.0 END, 9) AS error_rate,
  round(CASE WHEN count(*) > 0 THEN count(CASE WHEN {ERR_A} THEN 1 END) / count(*) ELSE 0.0 END * 100.0, 9)
    AS error_rate_pct FROM calls""")
def q_error_rate(spark, sf):
    """D3: error share (predicate A)."""
    return ag.error_rate(calls(spark, sf))


@register("stats_by_model", _BY.format(key="model", tok=_TOK, err=ERR_A, where=""))
def q_stats_by_model(spark, sf):
    """Per-model calls, tokens, cost, latency, errors."""
    return ag.stats_by_model(calls(spark, sf))


@register("stats_by_endpoint", _BY.format(key="endpoint", tok=_TOK, err=ERR_A, where=""))
def q_stats_by_endpoint(spark, sf):
    """Per-endpoint stats."""
    return ag.stats_by_endpoint(calls(spark, sf))


@register("stats_by_provider", _BY.format(key="provider", tok="", err=ERR_A, where=""))
def q_stats_by_provider(spark, sf):
    """Per-provider stats (no token totals)."""
    return ag.stats_by_provider(calls(spark, sf))


@register("cost_desc_nulls_last", _BY.format(key="model", tok=_TOK, err=ERR_A, where=""))
def q_cost_desc_nulls_last(spark, sf):
    """Model groups ordered by nullable cost sum, NULLs last."""
    return ag.stats_by_model(calls(spark, sf))


@register("stats_by_agent", _BY.format(
    key="agent_name", tok=_TOK, err=ERR_A,
    where="WHERE agent_name IS NOT NULL AND call_ts >= TIMESTAMP '2024-01-02 00:00:00' "
          "AND call_ts <= TIMESTAMP '2024-01-28 23:59:59.999' AND contains(lower(model), 'o')"))
def q_stats_by_agent(spark, sf):
    """Per non-NULL agent under since/until/model."""
    return ag.stats_by_agent(calls(spark, sf), CallFilter(since="2024-01-02", until="2024-01-28", model="o"))


_WF = """SELECT workflow_id, count(*) AS calls, round(coalesce(sum(cost_usd), 0.0), 9) AS total_cost_usd,
  CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS total_latency_ms, count(DISTINCT agent_name) AS agents,
  count(CASE WHEN {err} THEN 1 END) AS error_count, min(call_ts) AS first_call, max(call_ts) AS last_call
  FROM calls WHERE workflow_id IS NOT NULL {extra} GROUP BY workflow_id"""


@register("workflow_summary", _WF.format(err=ERR_A, extra="AND contains(lower(provider), 'o')"))
def q_workflow_summary(spark, sf):
    """Per-workflow summary (provider filter)."""
    return ag.workflow_summary(calls(spark, sf), CallFilter(provider="o"))


@register("workflow_recent", _WF.format(err=ERR_B, extra="") + " ORDER BY last_call DESC, workflow_id LIMIT 25")
def q_workflow_recent(spark, sf):
    """25 most recently active workflows, errors by predicate B."""
    return ag.workflow_recent(calls(spark, sf), 25)


@register("recent_workflows", _WF.format(err=ERR_B, extra="") + " ORDER BY last_call DESC, workflow_id LIMIT 10")
def q_recent_workflows(spark, sf):
    """Top 10 workflows by last call."""
    return ag.workflow_recent(calls(spark, sf), 10)


@register("daily_stats", f"""SELECT CAST(call_ts AS DATE) AS date, count(*) AS calls,
  round(coalesce(sum(cost_usd), 0.0), 9) AS cost_usd, count(CASE WHEN {ERR_A} THEN 1 END) AS error_count,
  round(coalesce(avg(latency_ms), 0.0), 9) AS avg_latency_ms FROM calls
  WHERE call_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY GROUP BY 1""")
def q_daily_stats(spark, sf):
    """Per-day stats over the last 20 days."""
    return ag.daily_stats(calls(spark, sf), days=20, as_of=AS_OF)


@register("cost_since", """SELECT round(coalesce(sum(cost_usd), 0.0), 9) AS cost FROM calls
  WHERE call_ts >= TIMESTAMP '2024-01-15 06:00:00'""")
def q_cost_since(spark, sf):
    """Cost at or after an instant."""
    return ag.cost_since(calls(spark, sf), "2024-01-15T06:00:00")


@register("cost_report", """SELECT model, count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(coalesce(sum(cost_usd), 0.0), 9) AS cost_usd,
  grouping(model) = 1 AS is_total, grouping(model) = 1 AND coalesce(sum(cost_usd), 0.0) > 50.0 AS over_budget
  FROM calls WHERE call_ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY ROLLUP (model)""")
def q_cost_report(spark, sf):
    """D12 + J2: per-model report with grand total and a budget flag."""
    return ag.cost_report(calls(spark, sf), CallFilter(since="2024-01-05"), fail_over_usd=50.0)


@register("eval_stats", f"""SELECT count(*) AS total_calls, count(CASE WHEN {ERR_B} THEN 1 END) AS error_count,
  round(CASE WHEN count(*) > 0 THEN count(CASE WHEN {ERR_B} THEN 1 END) / count(*) ELSE 0.0 END, 9) AS error_rate,
  coalesce({pct('latency_ms', 99)}, 0) AS latency_p99, round(coalesce(avg(cost_usd), 0.0), 9) AS avg_cost_usd
  FROM calls WHERE contains(lower(model), 'gpt') AND call_ts >= TIMESTAMP '2024-01-02 00:00:00'
  AND status_code BETWEEN 0 AND 499""")
def q_eval_stats(spark, sf):
    """Eval totals (errors B, exact p99) under model/time/status-range filters."""
    return ag.eval_stats(calls(spark, sf), CallFilter(model="gpt", since="2024-01-02", status_range="0-499"))


@register("compare_models", f"""WITH pair AS (SELECT * FROM (VALUES (0, 'gpt-4o'), (1, 'no-such-model')) t(side, model)),
  agg AS (SELECT model, count(*) AS calls, coalesce(avg(cost_usd), 0.0) AS avg_cost_usd,
    coalesce(sum(cost_usd), 0.0) AS total_cost_usd, coalesce(avg(latency_ms), 0.0) AS avg_latency_ms,
    {pct('latency_ms', 99)} AS latency_p99, count(CASE WHEN {ERR_B} THEN 1 END) AS errors,
    coalesce(avg(input_tokens), 0.0) AS avg_input_tokens, coalesce(avg(output_tokens), 0.0) AS avg_output_tokens
    FROM calls WHERE model IN ('gpt-4o', 'no-such-model') AND call_ts >= TIMESTAMP '2024-01-03 00:00:00'
    GROUP BY model)
  SELECT side, pair.model, coalesce(calls, 0) AS calls, round(coalesce(avg_cost_usd, 0.0), 9) AS avg_cost_usd,
    round(coalesce(total_cost_usd, 0.0), 9) AS total_cost_usd, round(coalesce(avg_latency_ms, 0.0), 9) AS avg_latency_ms,
    coalesce(latency_p99, 0) AS latency_p99,
    round(CASE WHEN coalesce(calls, 0) > 0 THEN errors / calls ELSE 0.0 END, 9) AS error_rate,
    round(coalesce(avg_input_tokens, 0.0), 9) AS avg_input_tokens, round(coalesce(avg_output_tokens, 0.0), 9) AS avg_output_tokens
  FROM pair LEFT JOIN agg USING (model)""")
def q_compare_models(spark, sf):
    """Two exact models side by side; the absent one is a zero row."""
    return ag.compare_models(calls(spark, sf), "gpt-4o", "no-such-model", since="2024-01-03")


@register("latency_percentiles", f"""SELECT coalesce({pct('latency_ms', 50)}, 0) AS p50,
  coalesce({pct('latency_ms', 95)}, 0) AS p95, coalesce({pct('latency_ms', 99)}, 0) AS p99 FROM calls""")
def q_latency_percentiles(spark, sf):
    """Exact p50/p95/p99 latency."""
    return pc.latency_percentiles(calls(spark, sf))


@register("latency_percentiles_by_model", f"""SELECT model, {pct('latency_ms', 50)} AS p50,
  {pct('latency_ms', 95)} AS p95, {pct('latency_ms', 99)} AS p99 FROM calls GROUP BY model""")
def q_latency_percentiles_by_model(spark, sf):
    """Exact latency percentiles per model."""
    return pc.latency_percentiles_by_model(calls(spark, sf))


@register("token_percentiles", f"""SELECT coalesce({pct('input_tokens', 50)}, 0) AS input_p50,
  coalesce({pct('input_tokens', 95)}, 0) AS input_p95, coalesce({pct('input_tokens', 99)}, 0) AS input_p99,
  coalesce({pct('o', 50)}, 0) AS output_p50, coalesce({pct('o', 95)}, 0) AS output_p95,
  coalesce({pct('o', 99)}, 0) AS output_p99
  FROM (SELECT input_tokens, coalesce(output_tokens, 0) AS o FROM calls
        WHERE input_tokens IS NOT NULL AND call_ts >= TIMESTAMP '2024-01-04 00:00:00')""")
def q_token_percentiles(spark, sf):
    """Exact token percentiles since a date."""
    return pc.token_percentiles(calls(spark, sf), since="2024-01-04")


@register("model_breakdown", f"""SELECT model, count(*) AS calls, {_TOK}
  round(coalesce(sum(cost_usd), 0.0), 9) AS total_cost_usd, round(coalesce(avg(latency_ms), 0.0), 9) AS avg_latency_ms,
  count(CASE WHEN {ERR_A} THEN 1 END) AS error_count, {pct('latency_ms', 99)} AS latency_p99
  FROM calls GROUP BY model""")
def q_model_breakdown(spark, sf):
    """Per-model stats with exact p99 latency."""
    return ag.model_breakdown(calls(spark, sf))


@register("workflow_detail", f"""SELECT 'wf-3' AS workflow_id, count(*) AS calls,
  round(coalesce(sum(cost_usd), 0.0), 9) AS total_cost_usd, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS total_latency_ms,
  list_sort(list(DISTINCT agent_name) FILTER (WHERE agent_name IS NOT NULL)) AS agents,
  count(DISTINCT agent_name) AS agent_count, count(CASE WHEN {ERR_A} THEN 1 END) AS error_count
  FROM calls WHERE workflow_id = 'wf-3'""")
def q_workflow_detail(spark, sf):
    """One workflow's totals and sorted agents."""
    return ag.workflow_detail(calls(spark, sf), "wf-3")


@register("workflow_costs_recent", """SELECT workflow_id, count(*) AS calls,
  round(coalesce(sum(cost_usd), 0.0), 9) AS cost_usd
  FROM (SELECT * FROM calls ORDER BY call_ts DESC, id DESC LIMIT 1000)
  WHERE workflow_id IS NOT NULL GROUP BY workflow_id""")
def q_workflow_costs_recent(spark, sf):
    """Per-workflow cost over the newest 1000 calls."""
    return ag.workflow_costs_recent(calls(spark, sf), 1000)


@register("latency_histogram", """WITH b AS (SELECT * FROM (VALUES (0, '<100ms'), (1, '100-250ms'),
    (2, '250-500ms'), (3, '500ms-1s'), (4, '1-2s'), (5, '2-5s'), (6, '>=5s')) t(bucket, label)),
  c AS (SELECT CASE WHEN latency_ms < 100 THEN 0 WHEN latency_ms < 250 THEN 1 WHEN latency_ms < 500 THEN 2
    WHEN latency_ms < 1000 THEN 3 WHEN latency_ms < 2000 THEN 4 WHEN latency_ms < 5000 THEN 5 ELSE 6 END AS bucket,
    count(*) AS n FROM calls WHERE latency_ms IS NOT NULL GROUP BY 1)
  SELECT b.bucket, b.label, coalesce(c.n, 0) AS n FROM b LEFT JOIN c USING (bucket)""")
def q_latency_histogram(spark, sf):
    """Seven latency buckets, zero-filled."""
    return ag.latency_histogram(calls(spark, sf))


@register("distinct_agents", """SELECT count(DISTINCT agent_name) AS n,
  list_sort(list(DISTINCT agent_name) FILTER (WHERE agent_name IS NOT NULL)) AS agents FROM calls""")
def q_distinct_agents(spark, sf):
    """Distinct agent count and list."""
    return ag.distinct_agents(calls(spark, sf))


@register("agent_rows", "SELECT agent_name, count(*) AS calls FROM calls WHERE agent_name IS NOT NULL GROUP BY agent_name")
def q_agent_rows(spark, sf):
    """D23 as rows: every distinct agent with its calls."""
    return ag.agent_rows(calls(spark, sf))


@register("workflow_agents", f"""SELECT agent_name, count(*) AS calls, round(coalesce(sum(cost_usd), 0.0), 9) AS total_cost_usd,
  CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS total_latency_ms, count(CASE WHEN {ERR_A} THEN 1 END) AS error_count
  FROM calls WHERE workflow_id = 'wf-3' GROUP BY agent_name""")
def q_workflow_agents(spark, sf):
    """D20 as rows: one workflow's totals per agent."""
    return ag.workflow_agents(calls(spark, sf), "wf-3")


@register("listing_total", f"""SELECT count(*) AS calls, round(coalesce(sum(cost_usd), 0.0), 9) AS cost_usd
  FROM (SELECT * FROM calls WHERE {ERR_A} ORDER BY call_ts DESC, id DESC LIMIT 200)""")
def q_listing_total(spark, sf):
    """Count and cost of the listed page (200 newest errors)."""
    return ag.listing_total(calls(spark, sf), CallFilter(errors_only=True), 200)


@register("top_models_by_cost", """SELECT model, round(coalesce(sum(cost_usd), 0.0), 9) AS cost_usd
  FROM calls GROUP BY model ORDER BY coalesce(sum(cost_usd), 0.0) DESC, model LIMIT 3""")
def q_top_models_by_cost(spark, sf):
    """Three most expensive models."""
    return ag.top_models_by_cost(calls(spark, sf), 3)
