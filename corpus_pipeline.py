"""A corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
result as Parquet in the shared folder and reads it as the next one's documents.

For all stages: null and empty texts are kept (two such documents are near-duplicates of each
other) and have no ids at the end; texts of any length are taken whole; equal ids rank by a hash
of the row; of rows equal in every column the near-duplicate stage keeps one; an empty table gives
an empty one; other columns are carried along unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import byte_bpe, decontaminate, simhash, substring_dedup, toxicity
from callscope.llm.common import prepare, spool, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not call toxic.

    Null and empty texts get the bias alone; repeated rows are judged alike and all kept; without
    labels of both classes nothing is learnt and the share of the label decides.
    """
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id; of ties, and where no id is known, the smallest row hash) of each group whose SimHash fingerprints link.

    Null and wordless texts have fingerprint zero and are one group.
    """
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences that an earlier document (or place) already holds.

    Documents rank by id (nulls last), ties by row hash; a text may become empty; null stays null.
    """
    prepare(spark)
    return substring_dedup.drop_repeated_units(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans that benchmark windows hit.

    Null texts stay null; an empty benchmark changes nothing; a text may become empty.
    """
    prepare(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: their number, and digests of the ids and of the decoded bytes (null: as empty)."""
    prepare(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks), ranks)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", remove_benchmark),
    ("byte_bpe", to_token_ids),
]

#: A classifier, vantage-point trees and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
