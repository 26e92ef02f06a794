"""Price lists of thousands of keys: hash lookup against plain search, and its cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from callscope.functions import prices as fp
from callscope.operators import pricing as pr


def plain(model, overrides):
    hits = sorted((k for k in overrides if model is not None and k in model), key=lambda k: (-len(k), k))
    return (*overrides[hits[0]], "override") if hits else None


def price_list(seed, n):
    rand = random.Random(seed)
    return {"".join(rand.choice("abé-4/") for _ in range(rand.randrange(1, 9))): (rand.random(), rand.random()) for _ in range(n)}


@pytest.mark.parametrize("n", [1, 7, 400])
def test_lookup_equals_plain_search(spark, n):
    overrides = price_list(n, n) | {"exact": (1.0, 2.0), "日本": (3.0, 4.0)}
    rand = random.Random(1)
    models = ["", None, "exact", "x exact y", "a日本b"] + ["".join(rand.choice("abé-4/xyz") for _ in range(rand.randrange(20))) for _ in range(300)]
    df = spark.createDataFrame([(m,) for m in models], "model string")
    rows = df.select("model", fp.override_lookup(F.col("model"), overrides).alias("p"), fp.override_expr(F.col("model"), {k: overrides[k] for k in list(overrides)[-20:]}).alias("few")).collect()
    few = {k: overrides[k] for k in list(overrides)[-20:]}
    for r in rows:
        assert (tuple(r.p) if r.p else None) == plain(r.model, overrides)
        assert (tuple(r.few) if r.few else None) == plain(r.model, few)


def test_calls_are_priced_alike_in_batch_and_stream(spark, make_calls, tmp_path):
    overrides = {f"key-{i}": (i / 7, i / 3) for i in range(300)} | {"gpt": (9.0, 8.0)}
    models = ["gpt-4o", "key-29", "a key-299 b", None, "", "nothing", "claude-3-5-sonnet"]
    calls = make_calls([dict(id=str(i), model=m or "", input_tokens=1000 * i, output_tokens=i) for i, m in enumerate(models)])
    batch = {r.id: r.cost_usd for r in pr.with_simple_cost(calls, overrides).collect()}
    p = fp.price_expr(F.col("model"), overrides)
    by_row = {r.id: r.c for r in calls.select("id", ((F.col("input_tokens") * p["input_per_mtok"] + F.col("output_tokens") * p["output_per_mtok"]) / 1e6).alias("c")).collect()}
    assert batch == pytest.approx(by_row)
    assert batch["1"] == pytest.approx((1000 * 29 / 7 + 29 / 3) / 1e6)


def test_thousands_of_keys_cost_little_more_than_ten(spark):
    calls = spark.range(100_000).select(F.concat(F.lit("vendor/model-"), (F.col("id") % 500).cast("string")).alias("model"),
                                        F.lit(10).cast("long").alias("input_tokens"), F.lit(5).cast("long").alias("output_tokens"), F.lit(None).cast("double").alias("cost_usd"))

    def seconds(overrides):
        run = lambda: pr.with_simple_cost(calls, overrides).agg(F.sum("cost_usd")).first()[0]
        run()
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    ten = seconds({f"model-{i}": (i, i) for i in range(10)})
    many = seconds({f"model-{i}": (i, i) for i in range(3000)})
    assert many < 3 * ten + 1, (ten, many)
    plan = pr.with_simple_cost(calls, {f"model-{i}": (i, i) for i in range(3000)})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 200
