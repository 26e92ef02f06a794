"""Value histograms per day kept with a calls store: exact percentiles without reading calls.

Below ``<store>/_histograms`` lie immutable segments of rows ``(call_date, model, measure, value,
n)``, one per append, named by a version file (``sources/versions.py``) and merged when there are
``FAN``. Counts add up over segments, days and models, so percentiles of any range of days come
from the histogram rows of those days alone. A store keeps histograms once ``create`` was called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.percentiles import histogram_percentiles, pivot_tokens
from callscope.sources.versions import Versions

#: Segments until they are merged into one.
FAN = 16


def histogram_rows(calls: DataFrame) -> DataFrame:
    """``call_date``, ``model``, ``measure`` (latency, input, output), ``value``, ``n`` of calls with ``call_date``."""
    known = F.col("input_tokens").isNotNull()
    values = F.array(*[F.struct(F.lit(name).alias("measure"), value.cast("long").alias("value")) for name, value in (
        ("latency", F.col("latency_ms")), ("input", F.col("input_tokens")), ("output", F.when(known, F.coalesce("output_tokens", F.lit(0)))))])
    return calls.select("call_date", "model", F.explode(values).alias("x")).select("call_date", "model", "x.measure", "x.value").where(
        "value is not null").groupBy("call_date", "model", "measure", "value").agg(F.count(F.lit(1)).alias("n"))


class DayHistograms:
    """The histograms of the store at ``store``."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self.root = f"{self.store}/_histograms"
        self.versions = Versions(spark, self.root)
        self.number, self.content = self.versions.current()

    def exists(self) -> bool:
        return self.number > 0

    def create(self, stored: DataFrame | None = None) -> None:
        """Start (or make anew) the histograms, of the calls that ``stored`` (with ``call_date``) has."""
        self._commit([] if stored is None else [self._write(histogram_rows(stored))])

    def add(self, calls: DataFrame) -> None:
        """Count new calls (with ``call_date``)."""
        self._commit([*self.content["segments"], self._write(histogram_rows(calls))])
        if len(self.content["segments"]) >= FAN:
            rows = self._rows().groupBy("call_date", "model", "measure", "value").agg(F.sum("n").alias("n"))
            self._commit([self._write(rows)])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex[:12]
        (rows.withColumn("seg", F.lit(name)).repartition("call_date").write.mode("append")
         .partitionBy("seg", "call_date").parquet(f"{self.root}/rows"))
        return name

    def _commit(self, segments: list[str]) -> None:
        before = self.versions.kept()
        self.content = {"segments": segments}
        self.number = self.versions.commit(self.content, self.number)
        named = {s for c in self.versions.kept() for s in c["segments"]}
        for gone in {s for c in before for s in c["segments"]} - named:
            self.versions.delete(f"rows/seg={gone}")

    def _rows(self) -> DataFrame:
        schema = "model string, measure string, value long, n long, seg string, call_date date"
        if not self.content.get("segments"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows").where(F.col("seg").isin(self.content["segments"]))

    def rows(self, since=None, until=None) -> DataFrame:
        """Histogram rows of the days from ``since`` to ``until`` (dates, both included).

        Of a store that retention has cut, days before the cut-off are left out, and the cut-off's
        own day, of which the histogram still holds all calls, is counted from the calls.
        """
        from callscope.sources.store import load_calls, read_cutoff

        rows = self._rows().drop("seg")
        cutoff = read_cutoff(self.spark, self.store)
        if cutoff is not None:
            calls = load_calls(self.spark, self.store, with_partition=True).where(F.col("call_date") == F.lit(cutoff.date()))
            rows = rows.where((F.col("call_date") > F.lit(cutoff.date())) | F.col("call_date").isNull()).unionByName(histogram_rows(calls))
        if since is not None:
            rows = rows.where(F.col("call_date") >= F.lit(since))
        return rows if until is None else rows.where(F.col("call_date") <= F.lit(until))

    def _counts(self, measures: list[str], keys: list[str], since, until) -> DataFrame:
        return self.rows(since, until).where(F.col("measure").isin(measures)).groupBy(*keys, "value").agg(F.sum("n").alias("_c"))

    def latency_percentiles(self, since=None, until=None) -> DataFrame:
        """p50/p95/p99 of latency over the days; zeros when there are none."""
        return histogram_percentiles(self._counts(["latency"], [], since, until), "value")

    def latency_percentiles_by_model(self, since=None, until=None) -> DataFrame:
        """The same, one row per model."""
        return histogram_percentiles(self._counts(["latency"], ["model"], since, until), "value", ["model"])

    def token_percentiles(self, since=None, until=None) -> DataFrame:
        """Input and output token percentiles over calls with known input tokens."""
        counts = self._counts(["input", "output"], ["measure"], since, until).withColumnRenamed("measure", "kind")
        return pivot_tokens(histogram_percentiles(counts, "value", ["kind"]))
