"""Ordered first-match joins against small rule tables.

Rules and routes are configuration-sized and become per-row expressions
(first match wins), so the rows keep their partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schema import ROUTES

# Upstream URL -> provider rules in first-match order.
# (all_of, any_of, provider); a rule matches when every all_of text and at
# least one any_of text (if given) is contained in the upstream URL.
PROVIDER_RULES = [
    (["bedrock", "amazonaws"], [], "bedrock"),
    ([], ["openai.azure.com", "azure.com/openai"], "azure-openai"),
    (["anthropic"], [], "anthropic"),
    (["openai"], [], "openai"),
    (["openrouter"], [], "openrouter"),
    (["x.ai"], [], "xai"),
    (["perplexity"], [], "perplexity"),
    ([], ["z.ai", "bigmodel", "zhipu"], "zhipu"),
    (["moonshot"], [], "moonshot"),
    (["fireworks"], [], "fireworks"),
    (["nvidia"], [], "nvidia"),
    (["together"], [], "together"),
    (["groq"], [], "groq"),
    (["mistral"], [], "mistral"),
    (["cohere"], [], "cohere"),
    ([], ["dashscope", "aliyun"], "qwen"),
    (["ai21"], [], "ai21"),
    ([], ["google", "generativelanguage"], "google"),
    (["deepseek"], [], "deepseek"),
    ([], ["ollama", "localhost", "127.0.0.1", "::1"], "ollama"),
]
UNKNOWN_PROVIDER = "unknown"


def with_provider(df: DataFrame, upstream_col: str = "upstream") -> DataFrame:
    """Label each row's upstream URL with a provider ('unknown' when no rule matches).

    A per-row expression over the fixed rules: the rows are not shuffled.
    """
    return df.withColumn("provider", F.coalesce(provider_expr(F.col(upstream_col)), F.lit(UNKNOWN_PROVIDER)))


def routes_df(spark: SparkSession, routes: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, p, u) for i, (p, u) in enumerate(routes)], ROUTES)


def route_match(path: Column, prefix: Column) -> Column:
    """'/' matches everything; otherwise exact, or prefix followed by '/'."""
    return ((prefix == F.lit("/")) | (path == prefix)
            | (path.startswith(prefix) & (F.substring(path, F.length(prefix) + 1, 1) == F.lit("/"))))


def resolve_upstream(df: DataFrame, routes: list[tuple[str, str]], default: str, path_col: str = "endpoint") -> DataFrame:
    """Per row, the upstream of the first of ``routes`` (prefix, upstream) matching its path, else ``default``.

    Routes are configuration, so they become a per-row expression: the rows are not shuffled.
    """
    return df.withColumn("upstream", route_expr(F.col(path_col), routes, F.lit(default)))


def shadowed_routes(routes: DataFrame) -> DataFrame:
    """Routes that can never match because an earlier route covers them.

    Self theta-join of the (configuration-sized) route table on rank_i < rank_j.
    """
    i = routes.select(F.col("rank").alias("rank_i"), F.col("path").alias("shadowed_by"))
    j = routes.select(F.col("rank").alias("rank_j"), F.col("path"))
    cond = (F.col("rank_i") < F.col("rank_j")) & route_match(F.col("path"), F.col("shadowed_by"))
    return (j.join(F.broadcast(i), cond, "inner")
            .select("rank_j", "path", "rank_i", "shadowed_by").orderBy("rank_j", "rank_i"))


def provider_expr(upstream: Column) -> Column:
    """C9 as a per-row CASE chain over the fixed provider rules (no join; ingest hot path)."""
    chain = None
    for all_of, any_of, label in PROVIDER_RULES:
        cond = F.lit(True)
        for p in all_of:
            cond = cond & upstream.contains(p)
        if any_of:
            alt = F.lit(False)
            for p in any_of:
                alt = alt | upstream.contains(p)
            cond = cond & alt
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return chain.otherwise(F.lit(UNKNOWN_PROVIDER))


def route_expr(path: Column, routes: list[tuple[str, str]], default: Column) -> Column:
    """C7 as a per-row CASE chain over a (configuration-sized) route list."""
    chain = None
    for prefix, upstream in routes:
        cond = route_match(path, F.lit(prefix))
        chain = F.when(cond, F.lit(upstream)) if chain is None else chain.when(cond, F.lit(upstream))
    return default if chain is None else chain.otherwise(default)
