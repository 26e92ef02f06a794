"""A growing full-text index: immutable segments, appended per batch, merged, read as one.

Below the index's folder lie ``postings/seg=../bucket=..`` (positional postings, bucketed by token
and sorted by token and impact block), ``lengths/seg=..`` (a row per record) and ``blocks/seg=..``
(for the tokens of about ``FREQUENT`` records and more: rows, greatest tf and least length of each
block). A version file (``sources/versions.py``) names the segments that count, each with its rows
and tokens; so a batch becomes visible at once, and a reader never meets half a segment.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import search as se
from callscope.operators.filters import _limit
from callscope.sources.versions import Versions

#: Segments of like size until they are merged; records from which a token's postings are told apart by block, of which one in
#: so many is looked at.
FAN, FREQUENT, SAMPLED = 8, 128, 8
#: Steps of tf and length per doubling that make an impact block, and times ``k`` rows that the first round reads at least.
TF_STEPS, LENGTH_STEPS, FIRST = 2, 4, 4

#: Bytes of postings that one task sorts and writes; a merge makes larger files of them.
PIECE = 8 << 20

_PARTS = ("postings", "lengths", "blocks")


class SearchIndex:
    """The index at ``root``. ``buckets`` is fixed by its first segment; ``add`` and ``merge`` expect one writer."""

    def __init__(self, spark: SparkSession, root: str, id_col: str = "id", columns=se.INDEXED_CALL_COLUMNS, buckets: int = se.DEFAULT_BUCKETS):
        self.spark, self.root, self.id_col, self.columns = spark, root.rstrip("/"), id_col, list(columns)
        self.versions = Versions(spark, self.root)
        self.number, self.content = self.versions.current()
        self.buckets = int(self.content.get("buckets", buckets))

    # -- reading ---------------------------------------------------------------------------------

    def segments(self) -> list[dict]:
        return self.content.get("segments", [])

    def _read(self, part: str, names: list[str] | None = None) -> DataFrame:
        names = [s["name"] for s in self.segments()] if names is None else names
        if not names:
            raise ValueError(f"no index at {self.root}")
        return self.spark.read.parquet(f"{self.root}/{part}").where(F.col("seg").isin(names))

    def postings(self) -> DataFrame:
        """``token``, ``id``, ``tf``, ``positions``, ``doc_len``, ``lead``, ``block``, ``bucket`` of all segments."""
        return self._read("postings").drop("seg")

    def lengths(self) -> DataFrame:
        """``id``, ``doc_len`` of every record, also of those without tokens."""
        return self._read("lengths").drop("seg")

    def stats(self) -> tuple[int, float, int]:
        """(records, tokens, buckets)."""
        return sum(s["rows"] for s in self.segments()), float(sum(s["tokens"] for s in self.segments())), self.buckets

    # -- writing ---------------------------------------------------------------------------------

    def replace(self, df: DataFrame) -> None:
        """Index ``df`` anew; the segments so far no longer count."""
        self._commit([self._segment(df)])

    def add(self, df: DataFrame) -> int:
        """C14: index the records of ``df`` whose id is not indexed yet, as a new segment; returns their number.

        An anti-join with the length tables, which have every record, also those without tokens.
        Segments of like size are merged when there are ``FAN`` of them.
        """
        todo = df
        if self.segments():
            todo = df.join(self.lengths().select(F.col("id").alias(self.id_col)), self.id_col, "left_anti")
        made = self._segment(todo)
        if made["rows"]:
            self._commit([*self.segments(), made])
            self.merge()
        return made["rows"]

    def _segment(self, df: DataFrame) -> dict:
        name = uuid.uuid4().hex[:12]
        rows = se.postings(df, self.id_col, self.columns)
        self._write_postings(rows, name)
        wordless = F.lit(True)
        for c in self.columns:  # stops at a text's first letter or digit
            wordless = wordless & ~F.coalesce(F.col(c).rlike(r"[\p{L}\p{N}]"), F.lit(False))
        leads = self._read("postings", [name]).where("lead").select("id", "doc_len")
        empty = df.where(wordless).select(F.col(self.id_col).alias("id"), F.lit(0).cast("long").alias("doc_len"))
        return self._finish(name, leads.unionByName(empty))

    def _write_postings(self, rows: DataFrame, name: str) -> None:
        steps = [F.floor(F.log2(F.greatest(F.col(c), F.lit(1))) * n).cast("int") for c, n in (("tf", TF_STEPS), ("doc_len", LENGTH_STEPS))]
        # blocks are numbered so that those of great impact (many hits, short record) come first
        block = (steps[1] * 64 + 63 - steps[0]).alias("block")
        rows = rows.select("token", block, "id", "tf", "positions", "doc_len", "lead", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int").alias("bucket"))
        # rebalance (not a plain repartition): AQE splits a bucket that holds a very frequent token over several tasks and files
        settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PIECE), "spark.sql.execution.arrow.maxBytesPerBatch": str(se.BYTES_SENT)}
        before = {key: self.spark.conf.get(key) for key in settings}
        try:
            for key, value in settings.items():
                self.spark.conf.set(key, value)
            (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "block")
             .write.partitionBy("bucket").option("parquet.block.size", str(32 << 20)).parquet(f"{self.root}/postings/seg={name}"))
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)

    def _finish(self, name: str, lengths: DataFrame) -> dict:
        """Lengths, block table and statistics of a segment whose postings are written."""
        lengths.write.parquet(f"{self.root}/lengths/seg={name}")
        n, tokens = se.corpus_stats(self._read("lengths", [name]))
        if tokens:
            # frequent tokens by a sample of records: of the others, which are many, no blocks are made
            rows = self._read("postings", [name]).select("token", "block", "tf", "doc_len", "id")
            some = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).groupBy("token").count().where(F.col("count") * SAMPLED >= FREQUENT)
            rows.join(some, "token", "left_semi").groupBy("token", "block").agg(
                F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("doc_len").alias("least_len")).write.parquet(f"{self.root}/blocks/seg={name}")
        return {"name": name, "rows": n, "tokens": tokens}

    def _commit(self, segments: list[dict]) -> None:
        before = self.versions.kept()
        self.content = {"buckets": self.buckets, "segments": segments}
        self.number = self.versions.commit(self.content, self.number)
        named = {s["name"] for c in self.versions.kept() for s in c["segments"]}
        for gone in {s["name"] for c in before for s in c["segments"]} - named:
            for part in _PARTS:
                self.versions.delete(f"{part}/seg={gone}")

    def merge(self) -> bool:
        """Rewrite ``FAN`` segments of like size as one (a record is rewritten once a size class); True if there were such."""
        classes: dict[int, list[dict]] = {}
        for s in self.segments():
            classes.setdefault(int(math.log(max(s["rows"], 1), FAN)), []).append(s)
        ripe = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
        if ripe is None:
            return False
        names = [s["name"] for s in ripe]
        name = uuid.uuid4().hex[:12]
        self._write_postings(self._read("postings", names), name)
        made = self._finish(name, self._read("lengths", names).select("id", "doc_len"))
        self._commit([s for s in self.segments() if s["name"] not in names] + [made])
        return True

    # -- ranked search ---------------------------------------------------------------------------

    def scores(self, query: str) -> DataFrame:
        """Every matching record with its ``rank``: all postings of the query's terms are read."""
        return se.bm25_scores(self.postings(), self.lengths(), query, self.stats())

    def top(self, query: str, k: int) -> DataFrame:
        """The best ``k`` of :meth:`scores`; of a one-token query, only blocks that can hold one of them are read.

        The block table bounds every block's score by its greatest tf and least length. Blocks are
        read from the best bound down until they hold ``FIRST`` x ``k`` rows; the k-th score found
        then rules out all blocks whose bound is lower, and the rest is read in a second pass.
        """
        k = _limit(k)
        phrases = se.parse_query(query)
        plan = self._plan(phrases[0][0]) if len(phrases) == 1 and len(phrases[0]) == 1 else None
        if plan is None:
            return self.scores(query).orderBy("rank", "id").limit(k)
        idf, blocks, rows = plan
        first, held = [], 0
        while blocks and held < FIRST * k:
            held += blocks[0][2]
            first.append(blocks.pop(0))
        found = self._ranks(rows, idf, [b[1] for b in first])
        ranks = [r["rank"] for r in found.select("rank").orderBy("rank").limit(k).collect()]
        # bounds and scores are the same expression of doubles; the slack is for their rounding
        rest = [b for b in blocks if len(ranks) < k or -b[0] <= ranks[-1] + 1e-9 * abs(ranks[-1])]
        if rest:
            found = self._ranks(rows, idf, [b[1] for b in first + rest])
        return found.orderBy("rank", "id").limit(k)

    def _plan(self, token: str) -> tuple[float, list[tuple[float, int, int]], DataFrame] | None:
        """(idf, [(greatest score, block, rows)], best first, postings) of a token; None if no segment has blocks of it.

        Segments in which the token is rare have none: their few rows have ``always`` set.
        """
        names = [s["name"] for s in self.segments() if s["tokens"]]
        table = self._read("blocks", names).where(F.col("token") == token).groupBy("seg", "block").agg(
            F.sum("n").alias("n"), F.max("most_tf").alias("tf"), F.min("least_len").alias("dl")).collect() if names else []
        if not table:
            return None
        told = sorted({r.seg for r in table})
        rows = se._restrict_buckets(self._read("postings", names), [token], self.buckets).where(F.col("token") == token).withColumn(
            "always", ~F.col("seg").isin(told))
        n, total, _ = self.stats()
        df = sum(b.n for b in table) + (rows.where("always").count() if len(told) < len(names) else 0)
        idf = math.log((n - df + 0.5) / (df + 0.5)) if n > df else 0.0
        idf = idf if idf > 0 else se.IDF_FLOOR
        bounds: dict[int, list] = {}
        for b in table:
            score = idf * b.tf * (se.BM25_K1 + 1) / (b.tf + se.BM25_K1 * (1 - se.BM25_B + se.BM25_B * b.dl / (total / n)))
            most, held = bounds.get(b.block, (0.0, 0))
            bounds[b.block] = (max(most, score), held + b.n)
        return idf, sorted(((most, block, held) for block, (most, held) in bounds.items()), reverse=True), rows

    def _ranks(self, rows: DataFrame, idf: float, blocks: list[int]) -> DataFrame:
        n, total, _ = self.stats()
        f, dl = F.col("tf").cast("double"), F.col("doc_len").cast("double")
        norm = F.lit(1.0 - se.BM25_B) + F.lit(se.BM25_B) * dl / F.lit(total / n)
        return rows.where(F.col("always") | F.col("block").isin(blocks)).select(
            "id", (-(F.lit(idf) * (f * F.lit(se.BM25_K1 + 1.0)) / (f + F.lit(se.BM25_K1) * norm))).alias("rank"))

    def search(self, records: DataFrame, query: str, limit: int = 20) -> DataFrame:
        """E3 + C1: the best ``limit`` matching records with their rank."""
        top = self.top(query, limit)
        return records.join(top.withColumnRenamed("id", self.id_col), self.id_col).orderBy("rank", self.id_col)
