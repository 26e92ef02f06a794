"""Helpers shared by the training-data operators: table reads, spooled tables, row keys, classes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import callscope
from callscope.session import checkpoint_root

#: Rows and bytes that go to a Python worker at once, so that a batch of long texts stays small.
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20
#: Bits of one row of Spark's bitmap functions.
BITMAP_ROW = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """UTC, small Arrow batches, and the package's code on the executors (once a session)."""
    sc = spark.sparkContext
    if not getattr(sc, "_callscope_shipped", False):
        sc._callscope_shipped = True
        home = os.path.dirname(os.path.dirname(os.path.abspath(callscope.__file__)))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "callscope"), "zip", home, "callscope"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/callscope-llm/{name}-{uuid.uuid4().hex[:12]}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe from lost executors."""
    return spool_to(df, name)[0]


def spool_to(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`spool`, with the path, for a caller that removes it once a later table replaces it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a spooled table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bitmap_bits(keys: int, each: int = 16, most: int = 1 << 28) -> int:
    """Bits of a bitmap for so many keys: a power of two, at most ``most`` (32 MB)."""
    return min(most, max(BITMAP_ROW, 1 << max(0, keys * each - 1).bit_length()))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap (bytes, least bit first) of the hashes in column ``h``, made of Spark's bitmap rows."""
    place = hashes.select((F.col("h").bitwiseAND(F.lit(bits - 1)) + 1).alias("place"))
    out = np.zeros(bits // 8, np.uint8)
    for r in place.groupBy(F.expr("bitmap_bucket_number(place)").alias("row")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("found")).collect():
        out[(r.row - 1) * BITMAP_ROW // 8 : r.row * BITMAP_ROW // 8] = np.frombuffer(r.found, np.uint8)[: BITMAP_ROW // 8]
    return out


def in_bitmap(spark: SparkSession, found: np.ndarray):
    """A condition on a column of hashes: false only for those that the bitmap was not made of."""
    sent = spark.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def known(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy().view(np.uint64) & np.uint64(len(sent.value) * 8 - 1)
        return pd.Series((sent.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return known


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until it is none of the columns' (Spark tells no upper from lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> list:
    """Two 64-bit hashes of a whole row, as columns ``_k1`` and ``_k2``: equal rows, and only they, share them.

    Null flags are hashed too, as Spark's hash passes over nulls; maps and variants are hashed as JSON.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        plain = isinstance(f.dataType, (T.AtomicType, T.NullType)) and not isinstance(f.dataType, T.VariantType)
        cols += [F.isnull(c), c if plain else F.to_json(F.struct(c.alias("c")))]
    return [F.xxhash64(F.lit(1), *cols).alias("_k1"), F.xxhash64(F.lit(2), *cols).alias("_k2")]


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row key is in ``keys`` (``_k1``, ``_k2``), each key's once."""
    keys = spool(keys.distinct(), "kept-keys")
    # a row travels as one column, so that its own columns cannot clash with the key's
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    kept = docs.select(row, *row_key(docs)).join(keys, ["_k1", "_k2"], "left_semi")
    repeated = spool(kept.groupBy("_k1", "_k2").count().where("count > 1").select("_k1", "_k2"), "kept-repeated")
    if repeated.isEmpty():
        return kept.select(*own)
    once = kept.join(repeated, ["_k1", "_k2"], "left_anti").select(*own)
    more = kept.join(repeated, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
    return once.union(more.select(*own))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an edge table (``a`` long, ``b`` long): one row (``node``, ``root``) per node.

    ``root`` is the smallest node of the component. Large-star and small-star steps
    alternate; every round is spooled, and the rounds end when the edges no longer change.
    Steps are joins and aggregations on nodes, so a hub is split like any skewed join key.
    """
    edges = spool(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), f"{name}-edges")
    nodes = spool(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), f"{name}-nodes")

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first()

    before = None
    while (now := mark(edges)) != before:
        before = now
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(
            low.select("a", F.col("m").alias("b")))
        edges = spool(small.distinct(), f"{name}-round")
    return nodes.join(edges.groupBy("a").agg(F.min("b").alias("root")), nodes.node == F.col("a"), "left").select(
        "node", F.coalesce("root", "node").alias("root"))
