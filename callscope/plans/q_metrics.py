"""Registered metric tables and exposition."""

from __future__ import annotations

from callscope.operators import metrics as mt
from callscope.plans.catalog import AS_OF, calls, register

_SC = ("CASE WHEN status_code = 0 THEN 'err' WHEN status_code BETWEEN 200 AND 299 THEN '2xx' "
       "WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code BETWEEN 500 AND 599 THEN '5xx' "
       "ELSE 'other' END")


@register("metric_calls", f"""SELECT model, provider, {_SC} AS status_class, count(*) AS n
  FROM calls GROUP BY ALL""")
def q_metric_calls(spark, sf):
    """Calls by model, provider, status class."""
    return mt.metric_calls(calls(spark, sf))


@register("metric_tokens", """SELECT * FROM (
  SELECT model, provider, 'input' AS type, CAST(sum(input_tokens) FILTER (WHERE input_tokens > 0) AS BIGINT) AS n
    FROM calls GROUP BY model, provider
  UNION ALL
  SELECT model, provider, 'output' AS type, CAST(sum(output_tokens) FILTER (WHERE output_tokens > 0) AS BIGINT) AS n
    FROM calls GROUP BY model, provider) WHERE n IS NOT NULL""")
def q_metric_tokens(spark, sf):
    """Positive token sums by model, provider, type."""
    return mt.metric_tokens(calls(spark, sf))


@register("metric_cost", """SELECT model, provider, round(sum(cost_usd), 9) AS usd FROM calls
  WHERE cost_usd > 0 GROUP BY model, provider""")
def q_metric_cost(spark, sf):
    """Positive cost sums by model, provider."""
    return mt.metric_cost(calls(spark, sf))


def _hist_sql(col: str, bounds=(100, 500, 1000, 5000)) -> str:
    parts = [f"SELECT model, '{b}' AS le, count(*) FILTER (WHERE {col} <= {b}) AS n, CAST(sum({col}) AS BIGINT) AS sum, "
             f"count({col}) AS count FROM calls WHERE {col} IS NOT NULL GROUP BY model" for b in bounds]
    parts.append(f"SELECT model, '+Inf' AS le, count({col}) AS n, CAST(sum({col}) AS BIGINT) AS sum, count({col}) AS count "
                 f"FROM calls WHERE {col} IS NOT NULL GROUP BY model")
    return " UNION ALL ".join(parts)


@register("metric_latency_hist", _hist_sql("latency_ms"))
def q_metric_latency_hist(spark, sf):
    """Cumulative latency buckets (100/500/1000/5000/+Inf), sum, count per model."""
    return mt.metric_latency_hist(calls(spark, sf))


@register("metric_ttft_hist", _hist_sql("ttft_ms", (50, 250, 2000)))
def q_metric_ttft_hist(spark, sf):
    """Cumulative time-to-first-token buckets with custom bounds."""
    return mt.metric_ttft_hist(calls(spark, sf), (50, 250, 2000))


@register("metric_agent_calls", """SELECT agent_name, count(*) AS n FROM calls
  WHERE agent_name IS NOT NULL GROUP BY agent_name""")
def q_metric_agent_calls(spark, sf):
    """Calls per agent."""
    return mt.metric_agent_calls(calls(spark, sf))


@register("metric_budget", f"""SELECT 'week' AS period, TIMESTAMP '2024-01-29 00:00:00' AS period_start,
  round(coalesce(sum(cost_usd), 0.0), 9) AS spent_usd, 5.0::DOUBLE AS limit_usd,
  CAST(floor(coalesce(sum(cost_usd), 0.0) / 5.0 * 100.0) AS BIGINT) AS pct,
  floor(coalesce(sum(cost_usd), 0.0) / 5.0 * 100.0) >= 80 AS near_limit,
  coalesce(sum(cost_usd), 0.0) >= 5.0 AS over_limit
  FROM calls WHERE call_ts >= TIMESTAMP '2024-01-29 00:00:00'""")
def q_metric_budget(spark, sf):
    """Spend in the current week (Monday start) against a 5 USD limit."""
    return mt.metric_budget(calls(spark, sf), 5.0, "week", "2024-01-30T10:00:00")


def _metrics_text_sql(prefix: str = "callscope", bounds=(100, 500, 1000, 5000)) -> str:
    """DuckDB text of the exposition rows (family, seq, k, line)."""
    sep = "chr(1)"
    heads = []
    for fam, name, help_, typ in [(1, "calls_total", "Calls in the table, by model, provider and status class", "counter"),
                                  (2, "tokens_total", "Tokens of the calls, by direction", "counter"),
                                  (3, "cost_usd_total", "Estimated cost of the calls in USD", "counter"),
                                  (4, "latency_ms", "Latency of the calls, milliseconds", "histogram"),
                                  (5, "ttft_ms", "Wait for the first token, milliseconds", "histogram"),
                                  (6, "agent_calls_total", "Calls of each agent", "counter"),
                                  (8, "budget_spent_usd",
                                   "Spend in the running budget period, USD", "gauge"),
                                  (9, "budget_limit_usd", "Limit of a budget period, USD", "gauge")]:
        heads.append(f"SELECT {fam} AS family, 0 AS seq, '' AS k, '# HELP {prefix}_{name} {help_}' AS line")
        heads.append(f"SELECT {fam}, 1, '', '# TYPE {prefix}_{name} {typ}'")
    parts = heads + [
        f"""SELECT 1, 2, concat_ws({sep}, model, provider, {_SC}),
            printf('{prefix}_calls_total{{model="%s",provider="%s",status_class="%s"}} %d',
                   model, provider, {_SC}, count(*)) FROM calls GROUP BY model, provider, {_SC}""",
        f"""SELECT 2, 2, concat_ws({sep}, model, provider),
            printf('{prefix}_tokens_total{{model="%s",provider="%s",type="input"}} %d', model, provider,
                   sum(input_tokens) FILTER (WHERE input_tokens > 0))
            FROM calls GROUP BY model, provider HAVING sum(input_tokens) FILTER (WHERE input_tokens > 0) IS NOT NULL""",
        f"""SELECT 2, 3, concat_ws({sep}, model, provider),
            printf('{prefix}_tokens_total{{model="%s",provider="%s",type="output"}} %d', model, provider,
                   sum(output_tokens) FILTER (WHERE output_tokens > 0))
            FROM calls GROUP BY model, provider HAVING sum(output_tokens) FILTER (WHERE output_tokens > 0) IS NOT NULL""",
        f"""SELECT 3, 2, concat_ws({sep}, model, provider),
            printf('{prefix}_cost_usd_total{{model="%s",provider="%s"}} %.8f', model, provider, sum(cost_usd))
            FROM calls WHERE cost_usd > 0 GROUP BY model, provider""",
        f"""SELECT 6, 2, agent_name, printf('{prefix}_agent_calls_total{{agent="%s"}} %d', agent_name, count(*))
            FROM calls WHERE agent_name IS NOT NULL GROUP BY agent_name""",
        f"""SELECT 8, 2, '', printf('{prefix}_budget_spent_usd{{period="%s"}} %.8f', 'month', coalesce(sum(cost_usd), 0.0))
            FROM calls WHERE call_ts >= TIMESTAMP '2024-01-01 00:00:00'""",
        f"""SELECT 9, 2, '', printf('{prefix}_budget_limit_usd{{period="%s"}} %.8f', 'month', 100.0)""",
    ]
    for fam, col, name in ((4, "latency_ms", "latency_ms"), (5, "ttft_ms", "ttft_ms")):
        les = [(str(b), str(b).rjust(12, "0"), f"{col} <= {b}") for b in bounds] + \
              [("+Inf", str(1 << 30).rjust(12, "0"), "true")]
        for le, order, cond in les:
            parts.append(f"""SELECT {fam}, 2, concat_ws({sep}, model, '{order}'),
                printf('{prefix}_{name}_bucket{{model="%s",le="%s"}} %d', model, '{le}', count(*) FILTER (WHERE {cond}))
                FROM calls WHERE {col} IS NOT NULL GROUP BY model""")
        parts.append(f"""SELECT {fam}, 2, concat_ws({sep}, model, '~1sum'),
            printf('{prefix}_{name}_sum{{model="%s"}} %.0f', model, CAST(sum({col}) AS DOUBLE))
            FROM calls WHERE {col} IS NOT NULL GROUP BY model""")
        parts.append(f"""SELECT {fam}, 2, concat_ws({sep}, model, '~2count'),
            printf('{prefix}_{name}_count{{model="%s"}} %d', model, count({col}))
            FROM calls WHERE {col} IS NOT NULL GROUP BY model""")
    return " UNION ALL ".join(f"({p})" for p in parts)


@register("metrics_text", _metrics_text_sql())
def q_metrics_text(spark, sf):
    """Exposition lines (HELP/TYPE headers, sorted samples) for all metric families."""
    return mt.metrics_exposition(calls(spark, sf), budget=(100.0, "month", AS_OF))
