"""Listing operators over the calls table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.predicates import CallFilter, error_class, parse_since, status_class, ts_literal
from callscope.schema import BODY_COLUMNS

PAGE_SIZE = 100


def _limit(n: int) -> int:
    """A caller's row limit, honoured as given."""
    if int(n) < 0:
        raise ValueError(f"a limit cannot be negative: {n}")
    return int(n)


def _f(f: CallFilter | None) -> CallFilter:
    return f or CallFilter()


def list_calls(df: DataFrame, f: CallFilter | None = None, limit: int = 100) -> DataFrame:
    """Filtered, newest first, the newest ``limit`` rows (distributed top-k)."""
    n = _limit(limit)
    return _f(f).apply(df).orderBy(F.col("call_ts").desc(), F.col("id").desc()).limit(n)


def all_calls(df: DataFrame, f: CallFilter | None = None) -> DataFrame:
    """Filtered, oldest first, no limit (range-partitioned sort)."""
    return _f(f).apply(df).orderBy("call_ts", "id")


def calls_after(df: DataFrame, cursor, f: CallFilter | None = None, limit: int = 100) -> DataFrame:
    """Strictly after the cursor instant, ascending, limited."""
    n = _limit(limit)
    c = ts_literal(parse_since(cursor))
    return (_f(f).apply(df).where(F.col("call_ts") > c)
            .orderBy("call_ts", "id").limit(n))


def call_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """At most one call whose id starts with ``prefix`` (earliest wins)."""
    return df.where(F.col("id").startswith(prefix)).orderBy("call_ts", "id").limit(1)


def hide_bodies(df: DataFrame) -> DataFrame:
    """Same rows, bodies replaced by typed NULLs."""
    for c in BODY_COLUMNS:
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def with_error_class(df: DataFrame) -> DataFrame:
    return df.withColumn("error_class", error_class())


def with_status_class(df: DataFrame) -> DataFrame:
    return df.withColumn("status_class", status_class())


def page_calls(df: DataFrame, f: CallFilter | None = None, page: int = 1) -> DataFrame:
    """B19: "load more" — page k shows the newest 100*k calls."""
    return list_calls(df, f, PAGE_SIZE * max(1, int(page)))


def page_after(df: DataFrame, cursor_ts, cursor_id: str, f: CallFilter | None = None,
               size: int = PAGE_SIZE) -> DataFrame:
    """B19 keyset form: the next ``size`` calls older than (cursor_ts, cursor_id)."""
    ts = ts_literal(parse_since(cursor_ts))
    older = (F.col("call_ts") < ts) | ((F.col("call_ts") == ts) & (F.col("id") < cursor_id))
    return (_f(f).apply(df).where(older)
            .orderBy(F.col("call_ts").desc(), F.col("id").desc()).limit(_limit(size)))


def recent_n(df: DataFrame, n: int = 100, f: CallFilter | None = None) -> DataFrame:
    """G1: newest N, displayed oldest first."""
    return list_calls(df, f, n).orderBy("call_ts", "id")


def llm_only(exchanges: DataFrame) -> DataFrame:
    """Keep exchanges that look like LLM traffic (model known or request body non-empty).

    Expects ``model`` (from request parsing) and ``request_body``; exchanges
    flagged ``is_stream``, where that column exists, are always kept.
    """
    keep = ((F.col("model") != "unknown")
            | (F.coalesce(F.octet_length("request_body"), F.lit(0)) > 0))
    if "is_stream" in exchanges.columns:
        keep = keep | F.col("is_stream")
    return exchanges.where(keep)
