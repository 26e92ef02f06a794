"""Headline benchmark: prints ONE JSON line with per-query wall seconds.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPS (default 3). Each query is run once to warm up, then timed
BENCH_REPS times (median reported). Results are fully computed with the
``noop`` sink (no driver collection).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from callscope.functions.predicates import CallFilter  # noqa: E402
from callscope.operators import aggregates as ag  # noqa: E402
from callscope.operators import filters as fl  # noqa: E402
from callscope.operators import percentiles as pc  # noqa: E402
from callscope.operators import pricing as pr  # noqa: E402
from callscope.operators import search as se  # noqa: E402
from callscope.session import get_spark, scratch_dir  # noqa: E402
from callscope.sources.fixtures import AS_OF, calls_view, read_table  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus, app="callscope-bench")
    spark.sparkContext.setLogLevel("ERROR")

    calls = calls_view(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents")
    index_root = scratch_dir(spark, "bench-index")
    state = {}

    def build_index():
        state["paths"] = se.write_index(docs, index_root, "doc_id", ["text"], buckets=max(8, cpus * 2))
        return None

    def search():
        idx, lens = se.read_index(spark, *state["paths"])
        stats = se.read_stats(spark, state["paths"][0])
        return se.search(docs, idx, lens, "worthless of-the", 20, "doc_id", stats)

    cost_ov = {"gpt-4o": (2.0, 8.0)}
    plans = {
        "D4_stats_by_model": lambda: ag.stats_by_model(calls),
        "D16_latency_percentiles_by_model": lambda: pc.latency_percentiles_by_model(calls),
        "D10_daily_stats": lambda: ag.daily_stats(calls, 90, AS_OF),
        "B11_list_calls_top100": lambda: fl.list_calls(
            calls, CallFilter(model="gpt-4o", status_range="400-599"), 100),
        "C2_H17_cost_reestimate": lambda: pr.with_simple_cost(calls, cost_ov)
        .groupBy("model").agg(F.sum("cost_usd").alias("cost_usd"))
        .join(pr.price_models(calls, cost_ov), "model"),
        "E1_index_build": build_index,
        "E3_search": search,
        "D8_workflow_summary": lambda: ag.workflow_summary(calls, CallFilter()),
    }

    def run(fn):
        df = fn()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()

    timings = {}
    for name, fn in plans.items():
        run(fn)  # warm-up (also builds the index for E3)
        ts = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(fn)
            ts.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(ts), 4)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
