import pytest
from pyspark.sql import functions as F

from callscope.operators import pricing as pr


def _prices(spark, models, overrides=None, default=None):
    df = spark.createDataFrame([(m,) for m in models], "model string")
    return {r.model: (r.input_per_mtok, r.output_per_mtok, r.source)
            for r in pr.price_models(df, overrides, default).collect()}


def test_bundled_and_fallback(spark):
    p = _prices(spark, ["gpt-4o", "totally-unknown", "gpt-4o-mini-2024", "", "jamba-1-5-large", "jamba-mini-x"])
    assert p["gpt-4o"][:2] == (2.5, 10.0)
    assert p["totally-unknown"] == (1.0, 3.0, "fallback")
    assert p["gpt-4o-mini-2024"][:2] == (0.15, 0.60)
    assert p[""][:2] == (0.0, 0.0)
    assert p["jamba-1-5-large"][:2] == (2.0, 8.0)


def test_overrides(spark):
    p = _prices(spark, ["my-custom-model-v2"], {"custom": (0.75, 2.00)})
    assert p["my-custom-model-v2"][:2] == (0.75, 2.0)
    p = _prices(spark, ["gpt-4o-mini-2024"], {"gpt": (9.0, 9.0), "gpt-4o-mini": (0.05, 0.05)})
    assert p["gpt-4o-mini-2024"][:2] == (0.05, 0.05)


def test_defaults(spark):
    p = _prices(spark, ["unknown-x", "gpt-4o"], None, (0.5, 1.5))
    assert p["unknown-x"][:2] == (0.5, 1.5)
    assert p["gpt-4o"][:2] == (2.5, 10.0)


def _cost(spark, inp, out, pin, pout, w=None, r=None, c=None):
    df = spark.createDataFrame([(inp, out, w, r, c)], "i long, o long, w long, r long, c long")
    return df.select(pr.cache_aware_cost(F.col("i"), F.col("o"), F.lit(pin), F.lit(pout),
                                         F.col("w"), F.col("r"), F.col("c")).alias("x")).first().x


def test_cache_costs(spark):
    assert _cost(spark, 1000, 200, 3.0, 15.0, r=900) == pytest.approx((100 * 3 + 900 * 0.30 + 200 * 15) / 1e6)
    assert _cost(spark, 1000, 0, 3.0, 15.0, w=800) == pytest.approx((200 * 3 + 800 * 3.75) / 1e6)
    assert _cost(spark, 1000, 0, 2.5, 10.0, c=800) == pytest.approx((200 * 2.5 + 800 * 1.25) / 1e6)
    assert _cost(spark, -1, 5, 2.5, 10.0) == 0.0


def test_with_simple_cost_matches_expression(spark, make_calls):
    from callscope.functions.prices import price_expr
    df = make_calls([dict(id=str(i), model=m) for i, m in enumerate(
        ["gpt-4o", "claude-3-5-sonnet-x", "llama3-1-70b", "qwen3-max", "nothing"])])
    a = {r.id: r.cost_usd for r in pr.with_simple_cost(df).collect()}
    p = price_expr(F.col("model"))
    b = {r.id: r.c for r in df.select("id", ((F.col("input_tokens") * p["input_per_mtok"]
                                               + F.col("output_tokens") * p["output_per_mtok"]) / 1e6)
                                      .alias("c")).collect()}
    assert a == pytest.approx(b)


def test_load_prices(spark, tmp_path):
    from callscope.operators.pricing import load_prices
    p = tmp_path / "prices.json"
    p.write_text('{"sample_spec": {"input_cost_per_token": 1}, "m1": {"input_cost_per_token": 0.000002, '
                 '"output_cost_per_token": 0.000008, "mode": "chat"}, "free": {"input_cost_per_token": 0}}')
    got = {r.model: (r.input_per_mtok, r.output_per_mtok) for r in load_prices(spark, str(p)).collect()}
    assert got.keys() == {"m1"}
    assert got["m1"] == pytest.approx((2.0, 8.0))


def test_price_expr_equals_rule_table(spark):
    """The guarded per-row expression gives the same first match as the join form."""
    from callscope.functions.prices import bundled_price_rows, price_expr
    names = ["", "x", "gpt-o1-mini", "o1-preview-x", "my-gpt-4o-mini", "claude-3-5-haiku", "jamba-1.7",
             "jamba-mini-2", "ai21.jamba-1-5-large-v1:0", "meta.llama3-1-70b-instruct", "qwen3-coder-next",
             "glm-4.5-flash", "gemini-1.5-flash-8b", "ollama/llama3", "local-model", "deepseek-r1-distill"]
    for _, pat, a, b, _, _ in bundled_price_rows():
        names += [pat, f"x-{pat}-y"] + a + b
    df = spark.createDataFrame([(n,) for n in sorted(set(names))], "model string")
    p = price_expr(F.col("model"))
    a = {r.model: (r.i, r.o, r.s) for r in df.select("model", p["input_per_mtok"].alias("i"),
                                                      p["output_per_mtok"].alias("o"), p["source"].alias("s")).collect()}
    b = {r.model: (r.input_per_mtok, r.output_per_mtok, r.source) for r in pr.price_models(df).collect()}
    assert a == b
