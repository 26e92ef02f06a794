"""The calls store on shared storage: load, append, retention, key/value meta.

Layout: parquet partitioned by ``call_date`` (UTC day of ``call_ts``), so
time filters prune whole directories and retention drops whole partitions.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.predicates import parse_since, ts_literal, utc_now, with_time_window
from callscope.schema import CALL_COLUMNS, CALLS
from callscope.sources.histograms import DayHistograms
from callscope.sources.ids import IdIndex


_STORE = T.StructType([*CALLS.fields, T.StructField("call_date", T.DateType())])
#: Retention's cut-off instant, in a file that Spark's listings pass over.
_CUTOFF = "_retention_cutoff"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has been created (an unreadable one raises where it is read)."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and any(not st.getPath().getName().startswith(("_", ".")) for st in fs.listStatus(p))


def read_cutoff(spark: SparkSession, path: str) -> dt.datetime | None:
    """The instant before which retention has deleted calls, if it ever did."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/{_CUTOFF}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return parse_since(stream.readUTF())
    finally:
        stream.close()


def load_calls(spark: SparkSession, path: str, fmt: str = "parquet", with_partition: bool = False) -> DataFrame:
    """A1: all calls with the fixed 22-column schema; absent columns read as typed NULLs.

    The schema is given, so no file footers are merged. A missing path is an
    error. Calls older than the store's retention cut-off are left out.
    ``with_partition`` keeps the ``call_date`` partition column, which lets
    time filters (``CallFilter``, ``with_time_window``) prune day directories.
    """
    if fmt != "parquet":
        return spark.read.schema(CALLS).format(fmt).load(path)
    df = spark.read.schema(_STORE).parquet(path)
    cutoff = read_cutoff(spark, path)
    if cutoff is not None:
        df = with_time_window(df, since=cutoff)
    return df if with_partition else df.drop("call_date")


def dedupe_batch(batch: DataFrame) -> DataFrame:
    """One row per id inside a batch: the earliest call_ts, then the smallest row content.

    Ids are counted first, so only the rows of repeated ids are reduced by
    an aggregate (``min`` over the row as a struct, map-side first: copies of
    one id are no hot group); all other rows pass as they are. Where no id is
    repeated, which a pass over the ids tells, no row is shuffled.
    """
    repeated = batch.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    others = [c for c in CALL_COLUMNS if c not in ("id", "call_ts")]
    row = F.struct(F.col("call_ts").alias("call_ts"), *[F.col(c).alias(c) for c in others])
    nameless = batch.where("id is null").groupBy("id").agg(F.min(row).alias("_r")).select("id", "_r.*").select(*CALL_COLUMNS)
    named = batch.where("id is not null").select(*CALL_COLUMNS)
    if repeated.isEmpty():
        return named.unionByName(nameless)
    again = batch.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(row).alias("_r")).select("id", "_r.*")
    once = named.join(repeated, "id", "left_anti")
    return once.select(*CALL_COLUMNS).unionByName(again.select(*CALL_COLUMNS)).unionByName(nameless)


def append_calls(batch: DataFrame, path: str) -> int:
    """A2: insert calls; an id already stored, on whatever day, or repeated in the batch is not inserted again.

    The store's id index (``sources/ids.py``) tells which ids are stored, so a micro-batch reads a
    few row groups of it and nothing of the store. The new rows are persisted once, counted and
    written, then indexed; returns their number. A batch that is replayed adds nothing, also after
    an append that broke off between the two (its mark makes the next one index what was written).
    Value histograms, where the store keeps them, count the new rows. One writer at a time.
    """
    spark = batch.sparkSession
    index, histograms = IdIndex(spark, path), DayHistograms(spark, path)
    stored = spark.read.schema(_STORE).parquet(path) if _exists(spark, path) else None
    if index.broken() and histograms.exists():
        histograms.create(stored)
    index.recover(stored)
    cutoff = read_cutoff(spark, path)
    new = dedupe_batch(batch.select(*CALL_COLUMNS)).withColumn("call_date", F.to_date("call_ts")).persist()
    fresh = index.unseen(new, cutoff.date() if cutoff else None).select(*CALL_COLUMNS, "call_date").persist()
    try:
        n = fresh.count()
        if n:
            mark = index.begin()
            fresh.hint("rebalance", "call_date").write.mode("append").partitionBy("call_date").parquet(path)
            if histograms.exists():
                histograms.add(fresh)
            index.add(fresh.select("id", "call_date"), n)
            index.end(mark)
    finally:
        fresh.unpersist()
        new.unpersist()
    return n


def prune_older_than(spark: SparkSession, path: str, days: int, as_of=None) -> int:
    """Delete calls older than ``days`` days before ``as_of``; returns rows deleted.

    0 keeps everything. The cut-off is written first (to a new file that
    replaces the old one), and from then on ``load_calls`` leaves older calls
    out; then the directories of whole days before it are deleted. No file is
    rewritten, so a crash loses nothing, a concurrent append stays, and
    streams over the store see no row again. Rows of the cut-off's own
    day go with their directory a day later.
    """
    if int(days) <= 0:
        return 0
    now = parse_since(as_of) if as_of is not None else utc_now()
    cutoff = now - dt.timedelta(days=int(days))
    before = read_cutoff(spark, path)
    if before is not None and before >= cutoff:
        return 0
    # partition filter first: only day directories up to the cut-off day are read
    old = load_calls(spark, path, with_partition=True).where(
        (F.col("call_date") <= F.lit(cutoff.date())) & (F.col("call_ts") < ts_literal(cutoff)))
    n = old.count()
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    target, fresh = (jvm.org.apache.hadoop.fs.Path(p, name) for name in (_CUTOFF, f"{_CUTOFF}.{uuid.uuid4().hex[:8]}"))
    stream = fs.create(fresh, True)
    stream.writeUTF(cutoff.isoformat())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, target, overwrite)
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("call_date=") and name != "call_date=__HIVE_DEFAULT_PARTITION__":
            if dt.date.fromisoformat(name.split("=", 1)[1]) < cutoff.date():
                fs.delete(st.getPath(), True)
    return n


def latest_by_key(meta: DataFrame) -> DataFrame:
    """key/value upserts -> the value of the latest write per key (ties by value)."""
    return meta.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"))
