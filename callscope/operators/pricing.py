"""Cost estimation and price-table operators.

Two forms share one rule table:

* ``price_models`` prices a DataFrame of *distinct* model names through a
  broadcast nested-loop join against the rule table (rules are a fixed,
  ~120-row dimension, so the broadcast has a proven size bound) and keeps
  the first matching rule per model with ``min_by``.
* ``price_expr`` (a per-row expression, no join) prices the calls themselves,
  in batch and in streams (``with_price``, ``with_simple_cost``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.prices import (
    CHAIN_KEYS,
    FALLBACK_PRICE,
    bundled_price_arrays,
    bundled_prices,
    matched_rank,
    override_expr,
    override_lookup,
    rule_matches,
)
from callscope.schema import OVERRIDES


def cost_formula(inp: Column, out: Column, pin: Column, pout: Column) -> Column:
    """(in*pi + out*po)/1e6; negative token counts give 0."""
    return (F.when((inp < 0) | (out < 0), F.lit(0.0))
            .otherwise((inp.cast("double") * pin + out.cast("double") * pout) / F.lit(1e6)))


def with_price(df: DataFrame, overrides: dict | None = None,
               default: tuple[float, float] | None = None, out: str = "_price") -> DataFrame:
    """Add ``out`` = struct(input_per_mtok, output_per_mtok, source) per row by model.

    Column expressions: no job runs while the plan is built, nothing is joined
    or shuffled, and batch and streaming rows are priced alike. The rule's rank
    and the override are columns of their own, so each is evaluated once a row.
    With a price list of many keys, a batch has its distinct models priced and
    joined back (one row a model; Spark broadcasts them if they are few).
    """
    if overrides and len(overrides) > CHAIN_KEYS and not df.isStreaming:
        priced = _with_price(df.select(F.col("model").alias("_priced_model")).distinct().withColumn("model", F.col("_priced_model")), overrides, default, out)
        return df.join(priced.drop("model"), F.col("model").eqNullSafe(F.col("_priced_model")), "left").drop("_priced_model")
    return _with_price(df, overrides, default, out)


def _with_price(df: DataFrame, overrides: dict | None, default: tuple[float, float] | None, out: str) -> DataFrame:
    rank, pin, pout, source, given = "_price_rank", "_price_in", "_price_out", "_price_source", "_price_own"
    fb = default or FALLBACK_PRICE
    ranked = df.withColumn(rank, matched_rank(F.col("model")))
    ins, outs = bundled_price_arrays()
    override = override_expr(F.col("model"), overrides)
    if override is not None:
        ranked = ranked.withColumn(given, override)
    own = lambda field: F.lit(None) if override is None else F.col(given)[field]
    known = F.col(rank).isNotNull()
    priced = ranked.withColumns({
        pin: F.coalesce(own("input_per_mtok"), F.when(known, F.element_at(ins, F.col(rank) + 1)), F.lit(float(fb[0]))),
        pout: F.coalesce(own("output_per_mtok"), F.when(known, F.element_at(outs, F.col(rank) + 1)), F.lit(float(fb[1]))),
        source: F.coalesce(own("source"), F.when(known, F.lit("bundled")), F.lit("fallback"))})
    return priced.withColumn(out, F.struct(F.col(pin).alias("input_per_mtok"), F.col(pout).alias("output_per_mtok"), F.col(source).alias("source"))) \
        .drop(rank, pin, pout, source, given)


def with_simple_cost(df: DataFrame, overrides: dict | None = None,
                     default: tuple[float, float] | None = None) -> DataFrame:
    """Fill ``cost_usd`` from tokens and the model's price (NULL when input is NULL)."""
    cols = [c for c in df.columns]
    df = with_price(df, overrides, default, "_price")
    p = F.col("_price")
    out = F.coalesce(F.col("output_tokens"), F.lit(0))
    cost = F.when(F.col("input_tokens").isNull(), F.lit(None).cast("double")).otherwise(
        cost_formula(F.col("input_tokens"), out, p["input_per_mtok"], p["output_per_mtok"]))
    return df.withColumn("cost_usd", cost).select(*cols)


def cache_aware_cost(inp: Column, out: Column, pin: Column, pout: Column,
                     cache_write: Column, cache_read: Column, cached: Column) -> Column:
    """Cache-aware cost.

    Anthropic cache counts (write x1.25, read x0.10) win when either is > 0;
    otherwise OpenAI cached tokens (x0.50); otherwise the simple formula.
    The uncached remainder is floored at 0.
    """
    w = F.coalesce(cache_write, F.lit(0))
    r = F.coalesce(cache_read, F.lit(0))
    c = F.coalesce(cached, F.lit(0))
    ant = (F.greatest(inp - w - r, F.lit(0)).cast("double") * pin
           + w.cast("double") * pin * F.lit(1.25)
           + r.cast("double") * pin * F.lit(0.10)
           + out.cast("double") * pout) / F.lit(1e6)
    oai = (F.greatest(inp - c, F.lit(0)).cast("double") * pin
           + c.cast("double") * pin * F.lit(0.50)
           + out.cast("double") * pout) / F.lit(1e6)
    simple = (inp.cast("double") * pin + out.cast("double") * pout) / F.lit(1e6)
    return (F.when((inp < 0) | (out < 0), F.lit(0.0))
            .when((w > 0) | (r > 0), ant)
            .when(c > 0, oai)
            .otherwise(simple))


def overrides_df(spark: SparkSession, overrides: dict | None) -> DataFrame:
    rows = [(k, float(v[0]), float(v[1])) for k, v in (overrides or {}).items()]
    return spark.createDataFrame(rows, OVERRIDES)


def price_models(models: DataFrame, overrides: dict | None = None,
                 default: tuple[float, float] | None = None,
                 model_col: str = "model") -> DataFrame:
    """Price each distinct model name: (model, input_per_mtok, output_per_mtok, source).

    Order: exact override -> longest contained override -> first bundled
    rule -> fallback (or ``default`` when given, C4). ``source`` is
    'override', 'bundled' or 'fallback'.
    """
    spark = models.sparkSession
    m = models.select(F.col(model_col).alias("model")).where(F.col("model").isNotNull()).distinct()
    rules = F.broadcast(bundled_prices(spark))
    bundled = (m.join(rules, rule_matches(F.col("model"), F.col("all_of"), F.col("any_of")), "left")
               .groupBy("model")
               .agg(F.min_by(F.struct("input_per_mtok", "output_per_mtok"), F.col("rank")).alias("b")))
    out = bundled
    if overrides:
        hit = m.withColumn("o", override_lookup(F.col("model"), overrides))
        out = out.join(hit, "model", "left")
    else:
        out = out.withColumn("o", F.lit(None).cast("struct<input_per_mtok:double,output_per_mtok:double>"))
    fb = default or FALLBACK_PRICE
    return out.select(
        "model",
        F.coalesce(F.col("o.input_per_mtok"), F.col("b.input_per_mtok"), F.lit(float(fb[0]))).alias("input_per_mtok"),
        F.coalesce(F.col("o.output_per_mtok"), F.col("b.output_per_mtok"), F.lit(float(fb[1]))).alias("output_per_mtok"),
        F.when(F.col("o").isNotNull(), "override").when(F.col("b.input_per_mtok").isNotNull(), "bundled")
        .otherwise("fallback").alias("source"))


def unknown_models(calls: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Models in the data with no exact override and only the fallback price."""
    spark = calls.sparkSession
    m = calls.select("model").where(F.col("model").isNotNull()).distinct()
    if overrides:
        m = m.join(overrides_df(spark, overrides).select(F.col("pattern").alias("model")), "model", "left_anti")
    priced = price_models(m)
    return priced.where(F.col("source") == "fallback").select("model", "input_per_mtok", "output_per_mtok")


def price_audit(calls: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Every model in the data plus every bundled pattern, with source.

    source = 'config' for an exact override, else 'bundled' / 'fallback'
    from the bundled table; ``in_db`` flags models present in the data.
    """
    spark = calls.sparkSession
    in_db = calls.select("model").where(F.col("model").isNotNull()).distinct().withColumn("in_db", F.lit(True))
    names = bundled_prices(spark).select(F.col("pattern").alias("model"))
    allm = in_db.select("model").unionByName(names).distinct()
    priced = price_models(allm)
    res = priced.join(in_db, "model", "left").withColumn("in_db", F.coalesce("in_db", F.lit(False)))
    if overrides:
        ov = overrides_df(spark, overrides).select(
            F.col("pattern").alias("model"), F.col("input_per_mtok").alias("oi"),
            F.col("output_per_mtok").alias("oo"))
        res = res.join(ov, "model", "left")
    else:
        res = res.withColumn("oi", F.lit(None).cast("double")).withColumn("oo", F.lit(None).cast("double"))
    return res.select(
        "model",
        F.when(F.col("oi").isNotNull(), "config").otherwise(F.col("source")).alias("source"),
        F.coalesce("oi", "input_per_mtok").alias("input_per_mtok"),
        F.coalesce("oo", "output_per_mtok").alias("output_per_mtok"),
        "in_db")


def load_prices(spark: SparkSession, json_path: str) -> DataFrame:
    """A4: a community price list (one JSON object: model -> per-token prices) as
    (model, input_per_mtok, output_per_mtok); skips the ``sample_spec`` entry and
    entries whose two prices are both zero. Usable directly as price overrides."""
    entry = "struct<input_cost_per_token:double,output_cost_per_token:double>"
    doc = spark.read.option("wholetext", "true").text(json_path)
    kv = doc.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("model", "p"))
    out = kv.where(F.col("model") != "sample_spec").select(
        "model",
        (F.coalesce(F.col("p.input_cost_per_token"), F.lit(0.0)) * F.lit(1e6)).alias("input_per_mtok"),
        (F.coalesce(F.col("p.output_cost_per_token"), F.lit(0.0)) * F.lit(1e6)).alias("output_per_mtok"))
    return out.where((F.col("input_per_mtok") > 0) | (F.col("output_per_mtok") > 0))


def save_price_cache(prices: DataFrame, path: str) -> None:
    """A4: persist a loaded price list (parquet) for later runs."""
    prices.write.mode("overwrite").parquet(path)
