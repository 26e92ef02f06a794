"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams of its words (with their ends marked),
each present or absent. Log-count ratios come from every labelled training row, counted by
Spark; the linear weights on the scaled features are then fitted to a bounded sample.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import prepare

#: Feature slots, n-gram lengths in characters (word ends included), and the most labelled rows that the weights are fitted to.
SLOTS, LENGTHS, TRAIN_ROWS = 1 << 18, (4, 6, 8, 10), 4000
#: Labels that are sent to the documents; more are joined with them in a shuffle.
SENT_LABELS = 2_000_000
#: Parts of the labels; part 0 is held out.
FOLDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _code_table() -> np.ndarray:
    """Code point to lower-case code point, zero for anything but letters (basic plane; others stay themselves)."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha() or ch.isdigit():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Features:
    """Text to feature slots."""

    _codes: np.ndarray | None = None

    @classmethod
    def slots(cls, text: str | None) -> np.ndarray:
        """Distinct slots of a text's n-grams, ascending. A long text is hashed in overlapping chunks."""
        if not text:
            return np.zeros(0, np.int64)
        if cls._codes is None:
            cls._codes = _code_table()
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        codes = np.where(points < 0x10000, cls._codes[np.minimum(points, 0xFFFF)], points)
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
        seen = np.zeros(SLOTS, bool)
        for a in range(0, len(codes), 1 << 18):
            part = codes[a : a + (1 << 18) + LENGTHS[-1]]
            inner = part == 0
            h = part.copy()
            bad = np.zeros(len(part), bool)  # a zero inside (not at an end) parts two words
            for n in range(2, LENGTHS[-1] + 1):
                m = len(part) - n + 1
                if m <= 0:
                    break
                bad = bad[:m] | (inner[n - 2 : n - 2 + m] if n > 2 else False)
                h = (h[:m] * _MIX) ^ part[n - 1 :]
                if n in LENGTHS:
                    mixed = h[~bad] * _MIX
                    seen[((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(64 - 18)).astype(np.int64)] = True
        return np.flatnonzero(seen)


def fold(doc_id) -> object:
    """The label part of an id column: crc32 of its text, modulo the number of parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weight per slot and bias, from labelled rows outside the held-out part.

    Rows without an id, label or text row take no part; an id labelled twice counts twice. The
    log-count ratios use every such row. The weights use those ``TRAIN_ROWS`` of them with the
    smallest id hashes (half of each class where there are enough). Without rows of both
    classes all weights are zero and the bias gives the smoothed share of the label.
    """
    prepare(docs.sparkSession)
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    own = own.where(fold(F.col("id")) != 0)
    known = F.broadcast(own) if own.count() <= SENT_LABELS else own
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(known, "id")

    def count(frames):
        seen, n = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for frame in frames:
            for y, text in zip(frame.y, frame.text, strict=True):
                seen[y, Features.slots(text)] += 1
                n[y] += 1
        at = np.flatnonzero(seen.any(0))
        if n.any():
            yield pd.DataFrame({"slot": np.append(at, -1), "zeros": np.append(seen[0, at], n[0]), "ones": np.append(seen[1, at], n[1])})

    # at most SLOTS + 1 rows of three numbers reach the driver
    counts = rows.select("y", "text").mapInPandas(count, "slot long, zeros long, ones long").groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()
    total = counts[counts.slot == -1]
    n0, n1 = (int(total.zeros.iloc[0]), int(total.ones.iloc[0])) if len(total) else (0, 0)
    if not n0 or not n1:
        return np.zeros(SLOTS, np.float32), float(np.log((n1 + 1) / (n0 + 1)))
    body = counts[counts.slot >= 0]
    ratio = np.zeros(SLOTS)
    log_ratio = np.log((body.ones + 1) / (n1 + 2)) - np.log((body.zeros + 1) / (n0 + 2))
    # drawn towards zero by a standard error, so that a few rows do not tell much
    error = np.sqrt(1 / (body.ones + 1) + 1 / (body.zeros + 1))
    ratio[body.slot] = np.where(body.ones + body.zeros < 3, 0, np.sign(log_ratio) * np.maximum(0, np.abs(log_ratio) - error))

    def slots(frames):
        for frame in frames:
            yield pd.DataFrame({"y": frame.y, "slots": [Features.slots(t).astype(np.int32).tobytes() for t in frame.text]})

    sample = []
    for y in (0, 1):
        chosen = rows.where(F.col("y") == y).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS // 2)
        picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id", "left_semi").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
        picked = picked.select(F.lit(y).alias("y"), "text").limit(TRAIN_ROWS // 2)  # rows that repeat an id do not add to the bound
        told = ratio != 0
        for r in picked.mapInPandas(slots, "y int, slots binary").toLocalIterator():
            own = np.frombuffer(r.slots, np.int32)
            sample.append((y, own[told[own]]))
    return _fit_linear(sample, ratio, n1 / (n0 + n1))


def _fit_linear(sample: list[tuple[int, np.ndarray]], ratio: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Logistic weights on the scaled features, by gradient steps on all rows (Adam); classes weigh as in the corpus."""
    ratio = ratio.astype(np.float32)
    sample = [(y, s[ratio[s] != 0]) for y, s in sample]
    y = np.array([r[0] for r in sample], np.float64)
    # 32-bit arrays: an entry for each feature that a row has
    owner = np.repeat(np.arange(len(sample), dtype=np.int32), [len(r[1]) for r in sample])
    column = np.concatenate([r[1] for r in sample]) if len(sample) else np.zeros(0, np.int32)
    value = ratio[column]
    used = np.flatnonzero(np.bincount(column, minlength=SLOTS))
    place = np.zeros(SLOTS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    column = place[column]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
    w, b = np.zeros(len(used)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, 151):
        z = np.bincount(owner, value * w.astype(np.float32)[column], len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        gw = np.bincount(column, value * g.astype(np.float32)[owner], len(used)) + 1e-3 * w
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        b -= 0.02 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    out = np.zeros(SLOTS, np.float32)
    out[used] = w * ratio[used]
    return out, float(b)


def score_column(spark, model: tuple[np.ndarray, float]):
    """A function of a text column: the score from 0 to 1; null and empty texts get the bias's."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        z = np.array([float(weights[Features.slots(t)].sum(dtype=np.float64)) for t in texts]) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` for each row (whole texts; a null id is not held out)."""
    spark = docs.sparkSession
    score = score_column(spark, fit(docs, labels, id_col, text_col))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(fold(F.col(f"`{id_col}`")) == 0, F.lit(False)).alias("held_out"),
                       score(F.col(f"`{text_col}`")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not call toxic (score below one half), unchanged."""
    score = score_column(docs.sparkSession, fit(docs, labels, id_col, text_col))
    return docs.where(score(F.col(f"`{text_col}`")) < 0.5)


def crc_fold(doc_id) -> int:
    """``fold`` of one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
