"""Registered queries: one Spark plan and (where expressible) one DuckDB oracle per key.

Each entry maps a SURVEY §2 key to ``(spark_fn(spark, sf_dir) -> DataFrame,
oracle_sql or None)``. Doubles are rounded to 9 decimals on both sides
(oracle hygiene); every LIMIT carries an ``id`` / key tie-break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.session import settle
from callscope.sources.fixtures import AS_OF, calls_view, with_calls

QueryFn = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def round_double(c, digits: int = 9):
    """Round a double as ``round(x * 10^d) / 10^d`` (the scaled binary form the oracle uses)."""
    m = float(10 ** digits)
    return F.round(c * F.lit(m)) / F.lit(m)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every top-level double column (comparison hygiene)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(round_double(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, oracle: str | None = None, calls_cte: bool = True, raw: bool = False):
    """Decorator: register ``fn(spark, sf_dir)``; oracle text gets the calls CTE.

    Aggregated doubles are rounded to 9 decimals (the oracle rounds too);
    ``raw=True`` keeps row-level values, which both engines compute bit-exactly.
    """
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # day buckets, date filters and timestamp casts are defined in UTC
            settle(spark)
            out = fn(spark, sf_dir)
            return out if raw else rounded(out)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        sql = None
        if oracle is not None:
            sql = with_calls(oracle) if calls_cte else oracle
        _REGISTRY[name] = (run, sql)
        return fn
    return deco


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_view(spark, sf_dir)


def all_queries() -> dict[str, QueryFn]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1] is not None}


_LOADED = False


def _load() -> None:
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    # importing the query modules fills the registry
    from callscope.plans import (  # noqa: F401
        q_aggregates,
        q_checks,
        q_enrich,
        q_exports,
        q_filters,
        q_joins,
        q_metrics,
        q_readback,
        q_search,
        q_store,
        q_streaming,
        q_windows,
    )


__all__ = ["AS_OF", "register", "calls", "all_queries", "all_oracles", "rounded"]
