"""Bundled model price table and the matching expression.

The table is data, not code: each row is a rule ``(rank, pattern, all_of,
any_of, input $/Mtok, output $/Mtok)``. A rule matches a model name when
every ``all_of`` text and at least one ``any_of`` text (if any are given)
is contained in the name, case-sensitively. A rule with neither list
matches only the empty model name. The first
matching rule in rank order wins; no match means the fallback price.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schema import PRICES

# The bundled price table in first-match order.
# pattern | input USD per 1M tokens | output USD per 1M tokens
BUNDLED_PRICE_TEXT = """
(empty model)|0.0|0.0
ollama|0.0|0.0
local-|0.0|0.0
self-hosted|0.0|0.0
gguf|0.0|0.0
text-embedding-3-large|0.13|0.0
text-embedding-3-small|0.02|0.0
text-embedding-ada-002|0.10|0.0
o1-mini|1.10|4.40
o1-preview|15.00|60.00
o1|15.00|60.00
o3-mini|1.10|4.40
o3|10.00|40.00
gpt-5.2|1.75|14.00
gpt-5.1-codex|0.25|2.00
codex-mini|1.50|6.00
gpt-5.1|1.25|10.00
gpt-5|1.25|10.00
gpt-4.1-mini|0.40|1.60
gpt-4.1-nano|0.10|0.40
gpt-4.1|2.00|8.00
gpt-4o-mini|0.15|0.60
gpt-4o|2.50|10.00
gpt-4-turbo|10.00|30.00
gpt-4|30.00|60.00
gpt-3.5|0.50|1.50
claude-opus-4-6|5.00|25.00
claude-opus-4-5|5.00|25.00
claude-opus-4|5.00|25.00
claude-sonnet-4-6|3.00|15.00
claude-sonnet-4-5|3.00|15.00
claude-sonnet-4|3.00|15.00
claude-haiku-4|1.00|5.00
claude-3-7-sonnet|3.00|15.00
claude-3-5-sonnet|3.00|15.00
claude-3-5-haiku|0.80|4.00
claude-3-opus|15.00|75.00
claude-3-sonnet|3.00|15.00
claude-3-haiku|0.25|1.25
gemini-3.1-pro|2.00|12.00
gemini-3.1-flash|0.10|0.40
gemini-3.1|2.00|12.00
gemini-3-pro|2.00|12.00
gemini-3|2.00|12.00
gemini-2.5-pro|1.25|10.00
gemini-2.5-flash|0.075|0.30
gemini-2.0-flash-lite|0.075|0.30
gemini-2.0-flash|0.10|0.40
gemini-2.0|0.10|0.40
gemini-1.5-flash-8b|0.0375|0.15
gemini-1.5-pro|1.25|5.00
gemini-1.5-flash|0.075|0.30
grok-3|3.00|15.00
grok-2|2.00|10.00
grok|5.00|15.00
llama-4-maverick|0.24|0.77
llama4-maverick|0.24|0.77
llama-4-scout|0.20|0.60
llama4-scout|0.20|0.60
llama-3.3-70b|0.59|0.79
llama3-3-70b|0.59|0.79
llama-3.2-90b|0.90|0.90
llama3-2-90b|0.90|0.90
llama-3.2-11b|0.18|0.18
llama3-2-11b|0.18|0.18
llama-3.2-3b|0.06|0.06
llama3-2-3b|0.06|0.06
llama-3.2-1b|0.04|0.04
llama3-2-1b|0.04|0.04
llama-3.1-405b|3.00|3.00
llama3-1-405b|3.00|3.00
llama-3.1-70b|0.52|0.75
llama3-1-70b|0.52|0.75
llama-3.1-8b|0.18|0.18
llama3-1-8b|0.18|0.18
mistral-large|2.00|6.00
mistral-medium|2.75|8.10
mistral-small|0.20|0.60
codestral|0.30|0.90
pixtral|2.00|6.00
mixtral|0.24|0.24
deepseek-r1|0.55|2.19
deepseek|0.14|0.28
command-r-plus|2.50|10.00
command-r|0.50|1.50
sonar-pro|3.00|15.00
sonar|1.00|5.00
nova-premier|2.50|12.50
nova-pro|0.80|3.20
nova-lite|0.06|0.24
nova-micro|0.035|0.14
jamba + -large|2.00|8.00
jamba + -mini|0.20|0.40
jamba|2.00|8.00
qwq-32b-preview|1.60|6.40
qwq|0.20|0.60
qwen3-coder-next|0.07|0.30
qwen3-coder|1.00|5.00
qwen3.5|0.90|3.60
qwen3-max|1.20|6.00
qwen3|0.40|1.20
qwen2.5-72b|0.15|0.40
qwen2.5-7b|0.10|0.30
qwen2.5|0.35|0.75
qwen-max|1.60|6.40
qwen-plus|0.30|1.20
qwen-turbo|0.05|0.20
qwen|0.40|1.20
kimi-k2.5|0.60|3.00
kimi|0.60|3.00
glm-5|1.00|3.20
glm-4.7-x|4.50|8.90
glm-4.7-flash|0.05|0.10
glm-4.7|0.60|2.20
glm-4.5-x|4.50|8.90
glm-4.5-flash|0.05|0.10
glm-4.5|0.55|2.00
glm-4|0.55|2.00
gemma|0.10|0.10
"""

# Rows whose match is not "name contains pattern".
# pattern -> (all_of, any_of); both empty = exact match on the empty name.
COMPOUND_PRICE_RULES = {
    "(empty model)": ([], []),
    "jamba + -large": (["jamba"], ["-large", "1.7"]),
    "jamba + -mini": (["jamba", "-mini"], []),
}

#: Override keys up to which a CASE chain is compiled; a longer list is looked up by hash.
CHAIN_KEYS = 50

# Price used when no rule matches (marks a model as unknown).
FALLBACK_PRICE = (1.00, 3.00)


def bundled_price_rows() -> list[tuple]:
    rows = []
    for rank, line in enumerate(l for l in BUNDLED_PRICE_TEXT.strip().splitlines()):
        pattern, pin, pout = line.split("|")
        all_of, any_of = COMPOUND_PRICE_RULES.get(pattern, ([pattern], []))
        rows.append((rank, pattern, all_of, any_of, float(pin), float(pout)))
    return rows


def bundled_prices(spark: SparkSession) -> DataFrame:
    """The bundled rule table as a (tiny, fixed-size) DataFrame."""
    return spark.createDataFrame(bundled_price_rows(), PRICES)


def rule_matches(text: Column, all_of: Column, any_of: Column) -> Column:
    """Column predicate: does rule (all_of, any_of) match ``text``."""
    all_ok = F.forall(all_of, lambda p: F.contains(text, p))
    any_ok = (F.size(any_of) == 0) | F.exists(any_of, lambda p: F.contains(text, p))
    empty_rule = (F.size(all_of) == 0) & (F.size(any_of) == 0)
    return F.when(empty_rule, text == F.lit("")).otherwise(all_ok & any_ok)


def _rule_expr(model: Column, all_of: list[str], any_of: list[str]) -> Column:
    if not all_of and not any_of:
        return model == F.lit("")
    cond = F.lit(True)
    for p in all_of:
        cond = cond & model.contains(p)
    if any_of:
        alt = F.lit(False)
        for p in any_of:
            alt = alt | model.contains(p)
        cond = cond & alt
    return cond


def _guard(all_of: list[str], any_of: list[str]) -> str | None:
    """A text every match of the rule must contain (first 3 chars of a required pattern)."""
    if all_of:
        return all_of[0][:3]
    return None  # OR-only or empty-name rules are always evaluated


def bundled_rank(model: Column) -> Column:
    """Rank of the first matching bundled rule (int), NULL when none matches.

    Rules are grouped into families by a guard text that every pattern of
    the family contains; a family is evaluated only when the model contains
    its guard, and the lowest rank over the families wins. Same result as a
    rank-ordered CASE over all rules, with far fewer substring tests per row.
    """
    families: dict[str | None, list[tuple]] = {}
    for rank, _pattern, all_of, any_of, _pi, _po in bundled_price_rows():
        families.setdefault(_guard(all_of, any_of), []).append((rank, all_of, any_of))
    parts = []
    for guard, rules in families.items():
        chain = None
        for rank, all_of, any_of in rules:
            cond = _rule_expr(model, all_of, any_of)
            chain = F.when(cond, F.lit(rank)) if chain is None else chain.when(cond, F.lit(rank))
        parts.append(chain if guard is None else F.when(model.contains(guard), chain))
    return F.least(*parts) if len(parts) > 1 else parts[0]


def matched_rank(model: Column) -> Column:
    """``bundled_rank`` with the model bound once.

    As the body of a lambda the rule chain is evaluated expression by
    expression; compiled into one method it would be too long for the JVM's
    compiler and run many times slower.
    """
    return F.element_at(F.transform(F.array(model), bundled_rank), 1)


def bundled_price_arrays() -> tuple[Column, Column]:
    """Input and output prices by rank."""
    rows = bundled_price_rows()
    return F.array(*[F.lit(float(r[4])) for r in rows]), F.array(*[F.lit(float(r[5])) for r in rows])


def override_expr(model: Column, overrides: dict[str, tuple[float, float]] | None) -> Column | None:
    """Price struct of the matching override (exact, else the longest contained; ties by pattern text), NULL without a match.

    Few keys are a CASE chain; a price list of many is looked up in a hash table.
    """
    ov = overrides or {}
    if len(ov) > CHAIN_KEYS:
        return override_lookup(model, ov)
    chain = None
    for k, test in [*((k, model == F.lit(k)) for k in ov), *((k, model.contains(k)) for k in sorted(ov, key=lambda x: (-len(x), x)))]:
        price = _price_struct(*ov[k], "override")
        chain = F.when(test, price) if chain is None else chain.when(test, price)
    return chain


def override_lookup(model: Column, overrides: dict[str, tuple[float, float]]) -> Column:
    """As :func:`override_expr`, by looking the model's substrings up in a hash table of the keys.

    The table is one constant: an array of buckets, a key's place being ``pmod(xxhash64(key), size)``.
    Only substrings as long as some key are looked up, so the work per row grows with the model's
    length and the number of different key lengths, not with the number of keys. An exact match is
    the longest substring there is.
    """
    size = 1 << (2 * len(overrides)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for k, (pin, pout) in overrides.items():
        h = xxhash.xxh64_intdigest(k.encode(), seed=42)  # Spark's xxhash64; its sign bit does not count in a power of two
        buckets[h % size].append({"k": k, "i": float(pin), "o": float(pout)})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<k:string,i:double,o:double>>>")
    lengths = F.array(*[F.lit(n) for n in sorted({len(k) for k in overrides}, reverse=True)])

    def found(text):
        own = F.element_at(table, (F.pmod(F.xxhash64(text), F.lit(size)) + 1).cast("int"))
        return F.filter(own, lambda e: e["k"] == text)

    def of_length(n):
        starts = F.when(F.length(model) >= n, F.sequence(F.lit(1), F.length(model) - n + 1))
        return F.flatten(F.transform(starts, lambda i: found(F.substring(model, i, n))))

    best = F.get(F.filter(F.transform(lengths, of_length), lambda hits: F.size(hits) > 0), F.lit(0))
    one = F.element_at(F.transform(F.array(F.array_min(best)), lambda e: F.when(e.isNotNull(), F.struct(
        e["i"].alias("input_per_mtok"), e["o"].alias("output_per_mtok"), F.lit("override").alias("source")))), 1)
    return one


def _price_struct(pin, pout, source: str) -> Column:
    return F.struct(F.lit(float(pin)).alias("input_per_mtok"), F.lit(float(pout)).alias("output_per_mtok"), F.lit(source).alias("source"))


def price_expr(model: Column, overrides: dict[str, tuple[float, float]] | None = None,
               default: tuple[float, float] | None = None) -> Column:
    """Per-row price lookup: struct(input_per_mtok, output_per_mtok, source).

    Lookup order: override, first bundled rule, fallback (``default`` replaces
    the fallback price; its source stays 'fallback'). No join and no shuffle.
    """
    ins, outs = bundled_price_arrays()
    fallback = _price_struct(*(default or FALLBACK_PRICE), "fallback")
    # the rank is bound by the lambda, so that its chain is evaluated once
    bundled = F.element_at(F.transform(F.array(matched_rank(model)), lambda rank: F.when(rank.isNotNull(), F.struct(
        F.element_at(ins, rank + 1).alias("input_per_mtok"), F.element_at(outs, rank + 1).alias("output_per_mtok"), F.lit("bundled").alias("source")))
        .otherwise(fallback)), 1)
    own = override_expr(model, overrides)
    return bundled if own is None else F.coalesce(own, bundled)
