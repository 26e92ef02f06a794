"""Deterministic ``calls`` stand-in built from the driver's ``events`` table.

The same projection text is rendered for Spark and for DuckDB (five token
substitutions), so the oracle sees row-for-row the same calls. The view
only shapes ``events`` rows into the CALLS schema; every operator then
works on it as it would on real captured calls.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schema import CALL_COLUMNS

AS_OF = "2024-01-31 00:00:00"

_TOKENS = {
    "spark": {"{S}": "STRING", "{J}": "get_json_object(props,'$.k')",
              "{T}": "(event_id div 10)", "{P}": "((event_id % 10 - 1) div 2)",
              "{Q4}": "c div 4", "{TS}": "CAST(ts AS TIMESTAMP)"},
    "duckdb": {"{S}": "VARCHAR", "{J}": "json_extract_string(props,'$.k')",
               "{T}": "(event_id // 10)", "{P}": "((event_id % 10 - 1) // 2)",
               "{Q4}": "c // 4", "{TS}": "ts"},
}

_INNER = "*, CAST(round(value*100) AS BIGINT) AS c, CAST({J} AS BIGINT) AS k"

_COLUMNS = [
    "lpad(CAST(event_id AS {S}), 8, '0') AS id",
    "{TS} AS call_ts",
    """CASE user_id % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic'
       WHEN 3 THEN 'google' WHEN 4 THEN 'groq' ELSE 'unknown' END AS provider""",
    """CASE user_id % 6 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini'
       WHEN 2 THEN 'claude-3-5-sonnet-20241022' WHEN 3 THEN 'gemini-2.5-pro'
       WHEN 4 THEN 'llama-3.1-70b' ELSE 'mystery-model-x' END AS model""",
    """CASE event_type WHEN 'view' THEN '/v1/embeddings'
       WHEN 'purchase' THEN '/v1/messages' ELSE '/v1/chat/completions' END AS endpoint""",
    """CAST(CASE WHEN event_type <> 'error' THEN 200
       ELSE CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 401 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 503 END
       END AS INT) AS status_code""",
    "c AS latency_ms",
    """CASE WHEN event_type = 'error' AND k % 5 = 0 THEN NULL
       WHEN event_id % 3 = 0 THEN {Q4} ELSE c END AS ttft_ms""",
    "CASE WHEN event_type = 'error' AND k % 5 = 0 THEN NULL ELSE k*10+1 END AS input_tokens",
    """CASE WHEN event_type = 'error' AND k % 5 = 0 THEN NULL
       WHEN event_type = 'view' THEN 0 ELSE c % 700 END AS output_tokens""",
    "CAST(NULL AS DOUBLE) AS cost_usd",
    "CAST(NULL AS {S}) AS request_body",
    "CAST(NULL AS {S}) AS response_body",
    """CASE WHEN event_type = 'error' AND k % 5 = 0 THEN
         CASE WHEN event_id % 3 = 0 THEN NULL
              WHEN event_id % 2 = 0 THEN 'connection refused' ELSE 'operation timed out' END
       WHEN event_type = 'signup' AND k = 9 THEN 'stream aborted' END AS error""",
    "CAST(NULL AS {S}) AS provider_request_id",
    "concat('trace-', CAST({T} AS {S})) AS trace_id",
    """CASE WHEN event_id % 10 = 0 THEN NULL
       ELSE lpad(CAST({T}*10 + {P} AS {S}), 8, '0') END AS parent_id""",
    "CAST(NULL AS {S}) AS prompt_hash",
    "CASE k % 10 WHEN 0 THEN 'exp-a' WHEN 1 THEN 'exp-b' END AS tags",
    """CASE user_id % 5 WHEN 1 THEN 'planner' WHEN 2 THEN 'researcher'
       WHEN 3 THEN 'writer' WHEN 4 THEN 'coder_x' END AS agent_name""",
    """CASE WHEN user_id % 7 = 0 THEN NULL
       ELSE concat('wf-', CAST(event_id % 40 AS {S})) END AS workflow_id""",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS span_name",
]

# Oracle-side prices of the six fixture models (per 1M tokens), used only
# by the DuckDB text; the Spark side prices through callscope's own rules.
_ORACLE_PRICES = [
    ("gpt-4o", "2.5", "10.0"), ("gpt-4o-mini", "0.15", "0.6"),
    ("claude-3-5-sonnet-20241022", "3.0", "15.0"), ("gemini-2.5-pro", "1.25", "10.0"),
    ("llama-3.1-70b", "0.52", "0.75"),
]


def _render(text: str, engine: str) -> str:
    for k, v in _TOKENS[engine].items():
        text = text.replace(k, v)
    return text


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def calls_view(spark: SparkSession, sf_dir: str, with_cost: bool = True) -> DataFrame:
    """CALLS-shaped DataFrame over ``events`` (cost priced by callscope)."""
    from callscope.operators.pricing import with_simple_cost

    ev = read_table(spark, sf_dir, "events")
    df = ev.selectExpr("*", "CAST(round(value*100) AS BIGINT) AS c",
                       _render("CAST({J} AS BIGINT) AS k", "spark"))
    df = df.selectExpr(*[_render(c, "spark") for c in _COLUMNS])
    if with_cost:
        df = with_simple_cost(df)
    return df.select(*CALL_COLUMNS)


def calls_view_duckdb() -> str:
    """DuckDB text of the same view, cost computed from the fixed price list."""
    cols = [_render(c, "duckdb") for c in _COLUMNS]
    cost_case = "CASE model " + " ".join(
        f"WHEN '{m}' THEN (input_tokens*{pi}::DOUBLE + output_tokens*{po}::DOUBLE)/1e6"
        for m, pi, po in _ORACLE_PRICES) + \
        " ELSE (input_tokens*1.0::DOUBLE + output_tokens*3.0::DOUBLE)/1e6 END"
    inner = ("SELECT " + ", ".join(cols) + " FROM (SELECT " + _render(_INNER, "duckdb")
             + " FROM events) e")
    sel = ", ".join(c if c != "cost_usd" else f"{cost_case} AS cost_usd" for c in CALL_COLUMNS)
    return f"SELECT {sel} FROM ({inner}) v"


def with_calls(sql: str) -> str:
    """Prefix an oracle query with the ``calls`` CTE (merging a leading WITH)."""
    head = f"WITH calls AS ({calls_view_duckdb()})"
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"{head}, {body[5:]}"
    return f"{head} {body}"
