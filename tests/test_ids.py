"""The store's id index: same answers as a look through the store, few row groups read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from callscope.session import scratch_dir
from callscope.sources import ids as ix
from callscope.sources import store as st

DAY = dt.datetime(2024, 5, 1)


def scanned(df):
    """(rows, files) that the scans of an executed query gave."""
    df.collect()
    todo, rows, files = [df._jdf.queryExecution().executedPlan()], 0, 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.startswith("Scan parquet"):
            metrics = node.metrics()
            rows += metrics.apply("numOutputRows").value()
            files += metrics.apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, files


def test_index_is_as_the_store(spark, make_calls, monkeypatch):
    monkeypatch.setattr(ix, "FAN", 2)
    monkeypatch.setattr(ix, "SMALL", 12)
    path = scratch_dir(spark, "t-ids-a")
    seen = set()
    for k in range(11):
        size = (1, 30, 7)[k % 3]
        rows = [dict(id=f"c{i}", call_ts=DAY + dt.timedelta(days=i % 5)) for i in range(4 * k, 4 * k + size)]
        new = {r["id"] for r in rows} - seen
        assert st.append_calls(make_calls(rows), path) == len(new)
        seen |= new
    assert sorted(r.id for r in st.load_calls(spark, path).collect()) == sorted(seen)
    index = ix.IdIndex(spark, path)
    assert {r.id for r in index.rows().collect()} == seen
    assert {r.level for r in index.rows().select("level").distinct().collect()} >= {1, 2}
    assert st.append_calls(st.load_calls(spark, path), path) == 0


def test_a_micro_batch_reads_few_row_groups(spark):
    path = scratch_dir(spark, "t-ids-b")
    index = ix.IdIndex(spark, path)
    calls = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(DAY.date()).alias("call_date"))
    index.add(calls, 200_000)
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "2000")
    try:
        known, unknown = [r.id for r in calls.limit(3).collect()], [f"{k:064x}" for k in range(3)]
        rows, files = scanned(index.held(known))
        assert 3 <= rows <= 3 * 200_000 / ix.BUCKETS * 1.2 and files <= 3
        assert scanned(index.held(unknown))[0] == 0  # Bloom filters
        plan = index.held(unknown)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in plan and "In(id" in plan or "Or(EqualTo(id" in plan
    finally:
        spark.conf.unset("spark.sql.parquet.pushdown.inFilterThreshold")


def test_an_append_that_broke_off_is_indexed_by_the_next(spark, make_calls, monkeypatch):
    path = scratch_dir(spark, "t-ids-c")
    rows = [dict(id=f"c{i}") for i in range(20)]
    assert st.append_calls(make_calls(rows[:5]), path) == 5
    with monkeypatch.context() as m:
        m.setattr(ix.IdIndex, "add", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            st.append_calls(make_calls(rows[:9]), path)
    assert st.append_calls(make_calls(rows), path) == 11
    assert sorted(r.id for r in st.load_calls(spark, path).collect()) == sorted(r["id"] for r in rows)


def test_a_store_without_index_gets_one(spark, make_calls):
    path = scratch_dir(spark, "t-ids-d")
    make_calls([dict(id="a"), dict(id="b")]).withColumn("call_date", F.to_date("call_ts")).write.mode("append").partitionBy("call_date").parquet(path)
    assert st.append_calls(make_calls([dict(id="b"), dict(id="c")]), path) == 1


def test_deleted_days_free_their_ids(spark, make_calls):
    path = scratch_dir(spark, "t-ids-e")
    st.append_calls(make_calls([dict(id="old", call_ts=dt.datetime(2020, 1, 1)), dict(id="new", call_ts=DAY)]), path)
    st.prune_older_than(spark, path, 3, DAY)
    assert st.append_calls(make_calls([dict(id="old", call_ts=DAY), dict(id="new", call_ts=DAY)]), path) == 1
    assert st.append_calls(make_calls([dict(id="old", call_ts=DAY)]), path) == 0
