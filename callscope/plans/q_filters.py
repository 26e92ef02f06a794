"""Registered listing / predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.predicates import (
    CallFilter,
    by_agent,
    by_model,
    by_provider,
    by_status,
    by_status_range,
    by_tag,
    by_time,
    by_workflow,
    is_error_a,
    is_error_b,
)
from callscope.operators import filters as fl
from callscope.plans.catalog import calls, register
from callscope.schema import CALL_COLUMNS

ALL = ", ".join(CALL_COLUMNS)
ERR_A = "(error IS NOT NULL OR status_code >= 400 OR status_code = 0)"
ERR_B = "(error IS NOT NULL OR status_code >= 400)"


@register("errors_only", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE {ERR_A}")
def q_errors_only(spark, sf):
    """B1: calls matching error predicate A."""
    return calls(spark, sf).where(is_error_a())


@register("errors_http", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE {ERR_B}")
def q_errors_http(spark, sf):
    """B2: calls matching error predicate B."""
    return calls(spark, sf).where(is_error_b())


@register("filter_model", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE contains(lower(model), 'gpt-4o')")
def q_filter_model(spark, sf):
    """Case-insensitive model substring."""
    return calls(spark, sf).where(by_model("GPT-4o"))


@register("filter_provider", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE contains(lower(provider), 'ai')")
def q_filter_provider(spark, sf):
    """Case-insensitive provider substring."""
    return calls(spark, sf).where(by_provider("AI"))


@register("filter_agent", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE contains(lower(agent_name), 'r_x')")
def q_filter_agent(spark, sf):
    """Agent substring; ``_`` is a literal character, NULL agents excluded."""
    return calls(spark, sf).where(by_agent("r_x"))


@register("filter_workflow", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE workflow_id = 'wf-7'")
def q_filter_workflow(spark, sf):
    """Exact workflow id."""
    return calls(spark, sf).where(by_workflow("wf-7"))


@register("filter_tag", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE tags = 'exp-a'")
def q_filter_tag(spark, sf):
    """Exact tag string."""
    return calls(spark, sf).where(by_tag("exp-a"))


@register("filter_time", raw=True, oracle=f"""SELECT {ALL} FROM calls
  WHERE call_ts >= TIMESTAMP '2024-01-10 00:00:00'
    AND call_ts <= TIMESTAMP '2024-01-12 23:59:59.999'""")
def q_filter_time(spark, sf):
    """Inclusive since/until with bare dates (until = end of day, ms precision)."""
    return calls(spark, sf).where(by_time("2024-01-10", "2024-01-12"))


@register("filter_status", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE status_code = 429")
def q_filter_status(spark, sf):
    """Exact status (wins over a range when both are set)."""
    f = CallFilter(status=429, status_range="400-599")
    return f.apply(calls(spark, sf))


@register("filter_status_range", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE status_code BETWEEN 500 AND 599")
def q_filter_status_range(spark, sf):
    """``LO-HI`` status range."""
    return calls(spark, sf).where(by_status_range("500-599"))


_LIST_F = CallFilter(model="gpt", status_range="200-299", since="2024-01-03")
_LIST_W = ("contains(lower(model), 'gpt') AND status_code BETWEEN 200 AND 299 "
           "AND call_ts >= TIMESTAMP '2024-01-03 00:00:00'")


@register("list_calls", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE {_LIST_W} ORDER BY call_ts DESC, id DESC LIMIT 100")
def q_list_calls(spark, sf):
    """Filtered listing, newest first, limit 100."""
    return fl.list_calls(calls(spark, sf), _LIST_F, 100)


@register("all_calls", raw=True, oracle=f"""SELECT {ALL} FROM calls WHERE contains(lower(provider), 'open')
  AND call_ts >= TIMESTAMP '2024-01-05 00:00:00' AND call_ts <= TIMESTAMP '2024-01-20 23:59:59.999'""")
def q_all_calls(spark, sf):
    """Every filtered call, oldest first."""
    return fl.all_calls(calls(spark, sf), CallFilter(provider="open", since="2024-01-05", until="2024-01-20"))


@register("calls_after", raw=True, oracle=f"""SELECT {ALL} FROM calls WHERE call_ts > TIMESTAMP '2024-01-20 12:00:00'
  AND {ERR_A} ORDER BY call_ts, id LIMIT 100""")
def q_calls_after(spark, sf):
    """Errors strictly after a cursor, ascending, limit 100."""
    return fl.calls_after(calls(spark, sf), "2024-01-20T12:00:00", CallFilter(errors_only=True), 100)


@register("call_by_prefix", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE starts_with(id, '0000123') ORDER BY call_ts, id LIMIT 1")
def q_call_by_prefix(spark, sf):
    """One call by id prefix (earliest match)."""
    return fl.call_by_prefix(calls(spark, sf), "0000123")


_NO_BODIES = ", ".join("CAST(NULL AS VARCHAR) AS " + c if c in ("request_body", "response_body") else c
                       for c in CALL_COLUMNS)


@register("hide_bodies", raw=True, oracle=f"SELECT {_NO_BODIES} FROM calls")
def q_hide_bodies(spark, sf):
    """All calls with bodies projected out."""
    return fl.hide_bodies(calls(spark, sf))


@register("error_class", raw=True, oracle="""SELECT id, status_code, error,
  CASE WHEN error IS NOT NULL OR status_code >= 400 OR status_code = 0 THEN
    CASE WHEN status_code IN (401, 403) THEN 'auth' WHEN status_code = 429 THEN 'rate_limit'
         WHEN status_code >= 500 THEN 'upstream_5xx'
         WHEN status_code = 0 AND (contains(error, 'timeout') OR contains(error, 'timed out')) THEN 'timeout'
         WHEN status_code = 0 AND contains(error, 'connection') THEN 'connection' END END AS error_class
  FROM calls""")
def q_error_class(spark, sf):
    """Error class label per call."""
    return fl.with_error_class(calls(spark, sf)).select("id", "status_code", "error", "error_class")


@register("status_class", raw=True, oracle="""SELECT id, status_code,
  CASE WHEN status_code = 0 THEN 'err' WHEN status_code BETWEEN 200 AND 299 THEN '2xx'
       WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code BETWEEN 500 AND 599 THEN '5xx'
       ELSE 'other' END AS status_class FROM calls""")
def q_status_class(spark, sf):
    """Status class label per call."""
    return fl.with_status_class(calls(spark, sf)).select("id", "status_code", "status_class")


@register("page_calls", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE {ERR_A} ORDER BY call_ts DESC, id DESC LIMIT 300")
def q_page_calls(spark, sf):
    """Third "load more" page of errors (newest 300)."""
    return fl.page_calls(calls(spark, sf), CallFilter(errors_only=True), 3)


@register("recent_n", raw=True, oracle=f"SELECT {ALL} FROM calls ORDER BY call_ts DESC, id DESC LIMIT 50")
def q_recent_n(spark, sf):
    """G1: newest 50 calls, shown oldest first."""
    return fl.recent_n(calls(spark, sf), 50)


@register("order_asc", raw=True, oracle=f"SELECT {ALL} FROM calls")
def q_order_asc(spark, sf):
    """All calls in ascending time order."""
    return fl.all_calls(calls(spark, sf))


@register("filter_combined", raw=True, oracle=f"""SELECT {ALL} FROM calls WHERE {ERR_A}
  AND contains(lower(model), 'claude') AND contains(lower(provider), 'anthropic')
  AND contains(lower(agent_name), 'writer') AND workflow_id IS NOT NULL AND tags = 'exp-b'""")
def q_filter_combined(spark, sf):
    """B3-B9 AND-ed: all set predicates in one filter object."""
    df = calls(spark, sf)
    f = CallFilter(errors_only=True, model="claude", provider="anthropic", agent="writer", tag="exp-b")
    return f.apply(df).where(F.col("workflow_id").isNotNull())


@register("status_exact", raw=True, oracle=f"SELECT {ALL} FROM calls WHERE status_code = 0")
def q_status_exact(spark, sf):
    """Connection failures (status 0)."""
    return calls(spark, sf).where(by_status(0))


@register("page_after", raw=True, oracle=f"""SELECT {ALL} FROM calls
  WHERE call_ts < TIMESTAMP '2024-01-05 00:00:00' OR (call_ts = TIMESTAMP '2024-01-05 00:00:00' AND id < '00001000')
  ORDER BY call_ts DESC, id DESC LIMIT 100""")
def q_page_after(spark, sf):
    """B19 keyset form: the 100 calls just older than a (timestamp, id) cursor."""
    return fl.page_after(calls(spark, sf), "2024-01-05T00:00:00", "00001000", None, 100)
