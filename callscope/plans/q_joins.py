"""Registered pricing, routing, trace and workflow join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.prices import FALLBACK_PRICE, bundled_price_rows
from callscope.operators import pricing as pr
from callscope.operators import routing as rt
from callscope.operators import workflows as wf
from callscope.operators.calendar import calendar_fill
from callscope.operators.checks import model_delta
from callscope.plans.catalog import AS_OF, calls, register
from callscope.schema import CALL_COLUMNS

ALL = ", ".join(CALL_COLUMNS)
ALL_C = ", ".join(f"c.{c}" for c in CALL_COLUMNS)

OVERRIDES = {"gpt-4o": (2.0, 8.0), "claude": (2.8, 14.0), "mystery-model": (0.75, 2.0), "mystery": (0.5, 1.0)}
ROUTES = [("/v1/messages", "https://api.anthropic.com"), ("/v1", "https://api.openai.com"),
          ("/v1/embeddings", "https://embeddings.example.net")]
DEFAULT_UPSTREAM = "http://localhost:11434"


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


def _rules_values() -> str:
    rows = ", ".join(
        f"({rank}, '{pat}', {_sql_list(a)}, {_sql_list(b)}, {pi}::DOUBLE, {po}::DOUBLE)"
        for rank, pat, a, b, pi, po in bundled_price_rows())
    return f"(SELECT * FROM (VALUES {rows}) t(rank, pattern, all_of, any_of, pin, pout))"


def _match(text: str) -> str:
    return (f"(CASE WHEN len(r.all_of) = 0 AND len(r.any_of) = 0 THEN {text} = '' ELSE "
            f"(len(r.all_of) = 0 OR list_bool_and(list_transform(r.all_of, lambda p: contains({text}, p)))) AND "
            f"(len(r.any_of) = 0 OR list_bool_or(list_transform(r.any_of, lambda p: contains({text}, p)))) END)")


def _priced_sql(models_sql: str, overrides: dict | None = None, default=None) -> str:
    """DuckDB text: first-match bundled price, overrides (exact, then longest contained)."""
    fb = default or FALLBACK_PRICE
    ov = ""
    if overrides:
        vals = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in overrides.items())
        ov = f""", ov AS (SELECT * FROM (VALUES {vals}) t(opat, oi, oo)),
  oh AS (SELECT m.model, arg_max(oi, (CASE WHEN m.model = opat THEN 1 ELSE 0 END, length(opat), opat)) AS oi,
                arg_max(oo, (CASE WHEN m.model = opat THEN 1 ELSE 0 END, length(opat), opat)) AS oo
         FROM m JOIN ov ON contains(m.model, opat) GROUP BY m.model)"""
    sel_o = "oh.oi" if overrides else "NULL::DOUBLE"
    sel_oo = "oh.oo" if overrides else "NULL::DOUBLE"
    join_o = "LEFT JOIN oh USING (model)" if overrides else ""
    return f"""WITH m AS ({models_sql}),
  b AS (SELECT m.model, arg_min(r.pin, r.rank) AS bi, arg_min(r.pout, r.rank) AS bo, min(r.rank) AS brank
        FROM m LEFT JOIN {_rules_values()} r ON {_match('m.model')} GROUP BY m.model){ov}
  SELECT b.model, coalesce({sel_o}, bi, {fb[0]}::DOUBLE) AS input_per_mtok,
         coalesce({sel_oo}, bo, {fb[1]}::DOUBLE) AS output_per_mtok,
         CASE WHEN {sel_o} IS NOT NULL THEN 'override' WHEN brank IS NOT NULL THEN 'bundled' ELSE 'fallback' END AS source
  FROM b {join_o}"""


_DISTINCT_MODELS = "SELECT DISTINCT model FROM calls WHERE model IS NOT NULL"


@register("price_rules", _priced_sql(_DISTINCT_MODELS))
def q_price_rules(spark, sf):
    """First-match bundled price per distinct model (broadcast rules, min_by rank)."""
    return pr.price_models(calls(spark, sf))


@register("price_overrides", _priced_sql(_DISTINCT_MODELS, OVERRIDES))
def q_price_overrides(spark, sf):
    """Exact override, then longest contained override, then bundled, then fallback."""
    return pr.price_models(calls(spark, sf), OVERRIDES)


#: A price list of community size: thousands of keys of other vendors, and some that real model names contain.
PRICE_LIST = {f"vendor{i % 40}/series-{i}": (round(0.01 * (i % 700) + 0.01, 2), round(0.03 * (i % 900) + 0.02, 2)) for i in range(3000)} | OVERRIDES | {
    "gpt-4o-mini": (0.11, 0.44), "claude-3": (2.1, 9.5), "llama-3.1-70b": (0.41, 0.61)}


@register("price_list", _priced_sql(_DISTINCT_MODELS, PRICE_LIST))
def q_price_list(spark, sf):
    """A price list of 3,000 keys, looked up by hash of the model's substrings."""
    return pr.price_models(calls(spark, sf), PRICE_LIST)


@register("price_list_costs", f"""WITH p AS ({_priced_sql(_DISTINCT_MODELS, PRICE_LIST)})
  SELECT c.id, c.model, p.source, CASE WHEN c.input_tokens IS NULL THEN NULL WHEN c.input_tokens < 0 OR coalesce(c.output_tokens, 0) < 0 THEN 0.0
    ELSE (c.input_tokens * p.input_per_mtok + coalesce(c.output_tokens, 0) * p.output_per_mtok) / 1e6 END AS cost_usd
  FROM calls c JOIN p USING (model)""", raw=True)
def q_price_list_costs(spark, sf):
    """C3 + H17: every call priced by the 3,000-key list (distinct models priced once and joined back)."""
    c = calls(spark, sf).where(F.col("model").isNotNull())
    return pr.with_price(pr.with_simple_cost(c, PRICE_LIST), PRICE_LIST).select("id", "model", F.col("_price.source").alias("source"), "cost_usd")


@register("price_defaults", _priced_sql(_DISTINCT_MODELS, None, (0.5, 1.5)))
def q_price_defaults(spark, sf):
    """C4: caller-supplied fallback price for unknown models."""
    return pr.price_models(calls(spark, sf), None, (0.5, 1.5))


@register("unknown_models", f"""SELECT model, input_per_mtok, output_per_mtok FROM ({_priced_sql(
    "SELECT DISTINCT model FROM calls WHERE model IS NOT NULL AND model NOT IN ('gpt-4o')")})
    WHERE source = 'fallback'""")
def q_unknown_models(spark, sf):
    """Models without an exact override whose price is the fallback."""
    return pr.unknown_models(calls(spark, sf), {"gpt-4o": (2.0, 8.0)})


_AUDIT_MODELS = ("SELECT DISTINCT model FROM (SELECT model FROM calls WHERE model IS NOT NULL UNION ALL "
                 f"SELECT pattern AS model FROM {_rules_values()})")


@register("price_audit", f"""SELECT p.model, CASE WHEN p.model = 'gpt-4o' THEN 'config' ELSE p.source END AS source,
  CASE WHEN p.model = 'gpt-4o' THEN 2.0::DOUBLE ELSE p.input_per_mtok END AS input_per_mtok,
  CASE WHEN p.model = 'gpt-4o' THEN 8.0::DOUBLE ELSE p.output_per_mtok END AS output_per_mtok,
  p.model IN (SELECT model FROM calls) AS in_db
  FROM ({_priced_sql(_AUDIT_MODELS)}) p""")
def q_price_audit(spark, sf):
    """Data models plus bundled patterns with price source and in-data flag."""
    return pr.price_audit(calls(spark, sf), {"gpt-4o": (2.0, 8.0)})


@register("model_union", f"{_AUDIT_MODELS}")
def q_model_union(spark, sf):
    """Models in the data union bundled price patterns, deduplicated."""
    from callscope.functions.prices import bundled_prices

    c = calls(spark, sf)
    return (c.select("model").where(F.col("model").isNotNull())
            .unionByName(bundled_prices(spark).select(F.col("pattern").alias("model"))).distinct())


_COST_OV = {"gpt-4o": (2.0, 8.0)}


@register("cost_simple", """SELECT id, model, input_tokens, output_tokens,
  CASE WHEN input_tokens IS NULL THEN NULL
       WHEN input_tokens < 0 OR coalesce(output_tokens, 0) < 0 THEN 0.0
       ELSE (input_tokens * (CASE WHEN contains(model, 'gpt-4o') THEN 2.0 WHEN contains(model, 'claude-3-5-sonnet') THEN 3.0
             WHEN contains(model, 'gemini-2.5-pro') THEN 1.25 WHEN contains(model, 'llama-3.1-70b') THEN 0.52 ELSE 1.0 END)::DOUBLE
           + coalesce(output_tokens, 0) * (CASE WHEN contains(model, 'gpt-4o') THEN 8.0 WHEN contains(model, 'claude-3-5-sonnet') THEN 15.0
             WHEN contains(model, 'gemini-2.5-pro') THEN 10.0 WHEN contains(model, 'llama-3.1-70b') THEN 0.75 ELSE 3.0 END)::DOUBLE) / 1e6
  END AS cost_usd FROM calls""", raw=True)
def q_cost_simple(spark, sf):
    """Per-call cost re-estimated with an override map (CASE chain, no join)."""
    return pr.with_simple_cost(calls(spark, sf), _COST_OV).select(
        "id", "model", "input_tokens", "output_tokens", "cost_usd")


_ROUTES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{p}', '{u}')" for i, (p, u) in enumerate(ROUTES)) + ") t(rank, prefix, upstream))"
_ROUTE_MATCH = ("(r.prefix = '/' OR e.endpoint = r.prefix OR (starts_with(e.endpoint, r.prefix) "
                "AND substring(e.endpoint, length(r.prefix) + 1, 1) = '/'))")
_UPSTREAM_SQL = f"""WITH e AS (SELECT DISTINCT endpoint FROM calls WHERE endpoint IS NOT NULL),
  hit AS (SELECT e.endpoint, arg_min(r.upstream, r.rank) AS upstream FROM e LEFT JOIN {_ROUTES_SQL} r
          ON {_ROUTE_MATCH} GROUP BY e.endpoint)
  SELECT c.id, c.endpoint, coalesce(hit.upstream, '{DEFAULT_UPSTREAM}') AS upstream
  FROM calls c LEFT JOIN hit USING (endpoint)"""


@register("route_upstream", _UPSTREAM_SQL)
def q_route_upstream(spark, sf):
    """Ordered path-prefix routing of every call's endpoint, default when none match."""
    c = calls(spark, sf).select("id", "endpoint")
    return rt.resolve_upstream(c, ROUTES, DEFAULT_UPSTREAM).select("id", "endpoint", "upstream")


def _provider_case(col: str) -> str:
    parts = []
    for all_of, any_of, label in rt.PROVIDER_RULES:
        conds = [f"contains({col}, '{p}')" for p in all_of]
        if any_of:
            conds.append("(" + " OR ".join(f"contains({col}, '{p}')" for p in any_of) + ")")
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


@register("provider_label", f"""SELECT id, endpoint, upstream, {_provider_case('upstream')} AS provider
  FROM ({_UPSTREAM_SQL}) u""")
def q_provider_label(spark, sf):
    """Provider detected from each call's resolved upstream URL (first matching rule)."""
    c = calls(spark, sf).select("id", "endpoint")
    up = rt.resolve_upstream(c, ROUTES, DEFAULT_UPSTREAM)
    return rt.with_provider(up).select("id", "endpoint", "upstream", "provider")


_SELF = "(SELECT id FROM calls WHERE starts_with(id, '0000123') ORDER BY call_ts, id LIMIT 1)"


@register("trace_siblings", f"""SELECT {ALL}, parent_id IS NULL AS is_root, id = {_SELF} AS is_self
  FROM calls WHERE trace_id = (SELECT trace_id FROM calls WHERE id = {_SELF})""", raw=True)
def q_trace_siblings(spark, sf):
    """All calls of the looked-up call's trace with root/self flags."""
    return wf.trace_siblings(calls(spark, sf), "0000123")


@register("workflow_timeline", f"""SELECT {ALL},
  coalesce(parent_id IN (SELECT id FROM calls WHERE workflow_id = 'wf-7'), false) AS is_child
  FROM calls WHERE workflow_id = 'wf-7'""", raw=True)
def q_workflow_timeline(spark, sf):
    """C11: a workflow's calls ascending, flagging children of calls in the same workflow."""
    return wf.workflow_timeline(calls(spark, sf), "wf-7")


_CMP = """SELECT model, count(*)::DOUBLE AS calls, coalesce(avg(cost_usd), 0.0) AS avg_cost_usd,
    coalesce(sum(cost_usd), 0.0) AS total_cost_usd, coalesce(avg(latency_ms), 0.0) AS avg_latency_ms,
    coalesce(list_sort(list(latency_ms))[least(count(latency_ms)*99//100, count(latency_ms)-1)+1], 0)::DOUBLE AS latency_p99,
    CASE WHEN count(*) > 0 THEN count(CASE WHEN error IS NOT NULL OR status_code >= 400 THEN 1 END) / count(*) ELSE 0.0 END AS error_rate,
    coalesce(avg(input_tokens), 0.0) AS avg_input_tokens, coalesce(avg(output_tokens), 0.0) AS avg_output_tokens
  FROM calls WHERE model = '{m}' AND call_ts >= TIMESTAMP '2024-01-03 00:00:00' GROUP BY model"""


@register("model_delta", f"""WITH a AS ({_CMP.format(m='gpt-4o')}), b AS ({_CMP.format(m='claude-3-5-sonnet-20241022')}),
  la AS (UNPIVOT a ON calls, avg_cost_usd, total_cost_usd, avg_latency_ms, latency_p99, error_rate,
         avg_input_tokens, avg_output_tokens INTO NAME metric VALUE a),
  lb AS (UNPIVOT b ON calls, avg_cost_usd, total_cost_usd, avg_latency_ms, latency_p99, error_rate,
         avg_input_tokens, avg_output_tokens INTO NAME metric VALUE b),
  pos AS (SELECT * FROM (VALUES (0, 'calls', NULL), (1, 'avg_cost_usd', true), (2, 'total_cost_usd', true),
          (3, 'avg_latency_ms', true), (4, 'latency_p99', true), (5, 'error_rate', true),
          (6, 'avg_input_tokens', NULL), (7, 'avg_output_tokens', NULL)) t(pos, metric, lib))
  SELECT pos.pos, pos.metric, round(la.a, 9) AS a, round(lb.b, 9) AS b,
    CASE WHEN la.a = 0 THEN 'n/a' WHEN abs((lb.b - la.a) / la.a * 100.0) < 0.5 THEN '~'
         ELSE printf('%+.0f%%', (lb.b - la.a) / la.a * 100.0) END AS delta_pct,
    CASE WHEN pos.lib IS NULL THEN NULL WHEN abs(lb.b - la.a) < 0.001 * greatest(abs(la.a), 1.0) THEN ''
         WHEN lb.b < la.a THEN 'better' ELSE 'worse' END AS mark
  FROM pos JOIN la USING (metric) JOIN lb USING (metric)""")
def q_model_delta(spark, sf):
    """Metric-by-metric delta between two models with better/worse marks."""
    return model_delta(calls(spark, sf), "gpt-4o", "claude-3-5-sonnet-20241022", since="2024-01-03")


_ERR_A = "(error IS NOT NULL OR status_code >= 400 OR status_code = 0)"
_CAL_SQL = f"""WITH cal AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '2023-12-18', DATE '2024-01-31',
    INTERVAL 1 DAY) t(d)),
  daily AS (SELECT CAST(call_ts AS DATE) AS date, count(*) AS calls, coalesce(sum(cost_usd), 0.0) AS cost_usd,
    count(CASE WHEN {_ERR_A} THEN 1 END) AS error_count FROM calls GROUP BY 1)
  SELECT cal.date, coalesce(calls, 0) AS calls, coalesce(cost_usd, 0.0) AS cost_usd,
    coalesce(error_count, 0) AS error_count FROM cal LEFT JOIN daily USING (date)"""


@register("calendar_fill", f"SELECT date, calls, round(cost_usd, 9) AS cost_usd, error_count FROM ({_CAL_SQL})")
def q_calendar_fill(spark, sf):
    """Last 45 days to as_of, zero-filled."""
    return calendar_fill(calls(spark, sf), 45, AS_OF)

