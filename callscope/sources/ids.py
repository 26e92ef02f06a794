"""The id index of a calls store: which ids it holds, looked up without reading the store.

It lies in ``<store>/_ids``, which Spark's listings pass over: one row ``(id, call_date)`` per
stored call, partitioned by ``level`` and ``bucket`` (a hash of the id), every file sorted by id
and with a Parquet Bloom filter on it. A micro-batch adds one small file at level 0; when a level
has ``FAN`` generations of files, they are rewritten as one at the next level, so an id is rewritten
once a level and the number of files grows with the logarithm of the number of batches.

A lookup for few ids is a literal filter: it reads the ids' buckets only, and of those the row
groups whose smallest and largest id and Bloom filter allow one of them. A larger batch is joined
with the index. The index is a set, so a row written twice, or a crash between the writing of a
merged file and the deletion of its sources, changes no answer.
"""

from __future__ import annotations

import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of the upper levels, generations of files until a level is merged.
BUCKETS, FAN = 32, 16
#: Ids that a lookup gives as literals, and rows that an append keeps in one file of level 0.
LITERALS, SMALL = 1000, 100_000
#: False-positive rate of the Bloom filters; with it, most lookups of ``LITERALS`` new ids read no row group.
RATE = 1e-5

_SCHEMA = "id string, call_date date, level int, bucket int"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return [st.getPath().toString() for st in fs.listStatus(p)] if fs.exists(p) else []


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[1]


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def bucket_of(ids):
    return F.pmod(F.xxhash64(ids), F.lit(BUCKETS)).cast("int")


def literal_bucket(one: str) -> int:
    """``bucket_of`` for one id on the driver (XXH64 of the UTF-8 bytes, seed 42, as a signed long)."""
    h = xxhash.xxh64_intdigest(one.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


class IdIndex:
    """The ids of the store at ``store``."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store
        self.path = f"{store.rstrip('/')}/_ids"

    def exists(self) -> bool:
        fs, p = _files(self.spark, self.path)
        return fs.exists(p)

    def rows(self) -> DataFrame:
        """All rows; of no files, none."""
        levels = [x for x in _children(self.spark, self.path) if _name(x).startswith("level=")]
        if not levels:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*levels)

    # -- writing ---------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, level: int, small: bool) -> None:
        rows = rows.where("id is not null").select("id", "call_date")
        if small:
            rows = rows.coalesce(1).sortWithinPartitions("id").withColumn("bucket", F.lit(-1))
        else:
            rows = rows.withColumn("bucket", bucket_of("id")).repartition("bucket").sortWithinPartitions("bucket", "id")
        (rows.withColumn("level", F.lit(level)).write.mode("append").partitionBy("level", "bucket")
         .option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
         .option("parquet.bloom.filter.fpp#id", str(RATE)).option("parquet.block.size", str(16 << 20)).parquet(self.path))

    def add(self, rows: DataFrame, n: int) -> None:
        """Index ``n`` new rows (``id``, ``call_date``)."""
        small = n <= SMALL
        self._write(rows, 0 if small else 1, small)
        self._merge()

    def _merge(self) -> None:
        for folder in sorted(_children(self.spark, self.path)):
            if not _name(folder).startswith("level="):
                continue
            level = int(_name(folder).split("=")[1])
            buckets = [[f for f in _children(self.spark, b) if _name(f).startswith("part-")] for b in _children(self.spark, folder)]
            if max(map(len, buckets), default=0) < FAN:
                continue
            old = [f for b in buckets for f in b]
            rows = self.spark.read.schema("id string, call_date date").parquet(*old)
            # an id that came again after its day was deleted counts from its latest day
            self._write(rows.groupBy("id").agg(F.max("call_date").alias("call_date")) if level else rows, level + 1, False)
            for f in old:
                _delete(self.spark, f)

    # -- an append in progress -------------------------------------------------------------------

    def begin(self) -> str:
        """A mark that stays if the append does not come to its end, so that the next one looks for rows without entry."""
        mark = f"{self.path}/_append-{uuid.uuid4().hex}"
        fs, p = _files(self.spark, mark)
        fs.create(p, True).close()
        return mark

    def end(self, mark: str) -> None:
        _delete(self.spark, mark)

    def _marks(self) -> list[str]:
        return [x for x in _children(self.spark, self.path) if _name(x).startswith("_append-")]

    def broken(self) -> bool:
        """Whether an append did not come to its end."""
        return bool(self._marks())

    def recover(self, stored: DataFrame | None) -> None:
        """Index the calls of ``stored`` (None: no store) that have no entry, if there is no index yet or an append broke off."""
        marks = self._marks()
        if self.exists() and not marks:
            return
        mark = self.begin()
        if stored is not None:
            rows = stored.select("id", "call_date").where("id is not null")
            if marks:
                rows = rows.join(self.rows().select("id").distinct(), "id", "left_anti")
            rows = rows.persist()
            try:
                if n := rows.count():
                    self.add(rows, n)
            finally:
                rows.unpersist()
        for old in [*marks, mark]:
            self.end(old)

    # -- lookup ----------------------------------------------------------------------------------

    def held(self, ids: list[str], since=None) -> DataFrame:
        """Rows of the given ids: buckets and row groups that cannot hold one are not read."""
        rows = self.rows().where(F.col("bucket").isin([-1, *sorted({literal_bucket(i) for i in ids})]) & F.col("id").isin(ids))
        return self._current(rows, since)

    @staticmethod
    def _current(rows: DataFrame, since) -> DataFrame:
        return rows if since is None else rows.where(F.col("call_date").isNull() | (F.col("call_date") >= F.lit(since)))

    def unseen(self, batch: DataFrame, since=None) -> DataFrame:
        """The rows of ``batch`` whose id is not held by a call of the day ``since`` or later (``since``: days before it were deleted)."""
        some = [r.id for r in batch.where("id is not null").select("id").limit(LITERALS + 1).collect()]
        if len(some) > LITERALS:
            return batch.join(self._current(self.rows(), since).select("id"), "id", "left_anti")
        if not some:
            return batch
        key = "spark.sql.parquet.pushdown.inFilterThreshold"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(LITERALS + 1))
        try:
            found = sorted({r.id for r in self.held(some, since).select("id").collect()})
        finally:
            self.spark.conf.set(key, before)
        return batch.where(F.col("id").isNull() | ~F.col("id").isin(found)) if found else batch
