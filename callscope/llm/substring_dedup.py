"""Substring dedup: units of text that stood earlier in the corpus are removed.

A text is cut into units: lines, paragraphs, or lines cut further at sentence ends (the
default, as shared passages also begin within a line). Units tile the text. A unit's
normalised words are digested; of all rows that hold a digest the earliest ranked keeps its
first occurrence, and the other occurrences go, with their offsets in the original text.
A unit of few words says little by itself, so it counts in runs: the shortest run of
consecutive units (over line and paragraph breaks) of enough words that begins with it, and
the shortest that ends with it. A run that stood earlier goes as a whole, whatever stands
around it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import partitions, prepare, row_key, spool

#: Words that a unit must have to count by itself.
MIN_WORDS = 10
_ENDS = {"line": re.compile(r"\n+"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*"), "sentence": re.compile(r"[.!?]+\s+|\n+")}
_WORDS = re.compile(r"\w+")
_DIGEST = xxhash.xxh3_128_digest


def units(text: str, by: str = "sentence", min_words: int = MIN_WORDS) -> tuple[list[int], list[list[tuple[int, bytes]] | None]]:
    """Starts of a text's units (and its length), and the runs that end with each unit: (first unit, digest); None: no run.

    A unit of ``min_words`` is a run by itself. Units without words are passed over.
    """
    bounds = [0, *(m.end() for m in _ENDS[by].finditer(text))]
    if bounds[-1] != len(text):
        bounds.append(len(text))
    low = text.lower() if text.isascii() else None
    runs: list[list[tuple[int, bytes]] | None] = [None] * (len(bounds) - 1)
    at, said, sizes = [], [], []  # of the units with words
    first, n = 0, 0  # of the shortest run that ends here
    ahead, n_ahead = 0, 0  # of the earliest unit whose run has not ended
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        words = _WORDS.findall(low[a:b] if low else text[a:b].lower())
        if not words:
            continue
        at.append(k)
        said.append(" ".join(words))
        sizes.append(len(words))
        n, n_ahead = n + len(words), n_ahead + len(words)
        if n < min_words:
            continue
        while n - sizes[first] >= min_words:
            n, first = n - sizes[first], first + 1
        runs[k] = own = [(at[first], _DIGEST(said[-1] if first == len(said) - 1 else "\n".join(said[first:])))]
        while n_ahead >= min_words:
            if ahead != first:
                own.append((at[ahead], _DIGEST("\n".join(said[ahead:]))))
            n_ahead, ahead = n_ahead - sizes[ahead], ahead + 1
    return bounds, runs


def cut(text: str, drop: set[bytes], by: str = "sentence", min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, int]]]:
    """The text without the runs whose digest is in ``drop`` or stood earlier in the text, and their (start, end).

    Of runs that overlap their own first occurrence, that occurrence stays. A line break that
    ends a removed unit stays where text stays before it on its line.
    """
    bounds, runs = units(text, by, min_words)
    gone, last = [False] * len(runs), {}
    for k, own in enumerate(runs):
        for first, d in own or ():
            if d not in drop:
                if d not in last:
                    last[d] = k
                    continue
                first = max(first, last[d] + 1)
            gone[first : k + 1] = [True] * (k + 1 - first)
    out, spans = [], []
    for a, b, go in zip(bounds, bounds[1:], gone, strict=False):
        part = text[a:b]
        if not go or not _WORDS.search(part):
            out.append(part)
            continue
        end = a + len(part.rstrip()) if part.endswith("\n") and out and not out[-1].endswith("\n") else b
        out.append(text[end:b])
        if spans and spans[-1][1] == a:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((a, end))
    return "".join(out), spans


def _digests(by: str, min_words: int):
    def digests(batches):
        for batch in batches:
            rids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(rids), 128):
                own = [{d for r in units(t, by, min_words)[1] if r for _, d in r} for t in texts[a : a + 128]]
                pairs = np.frombuffer(b"".join(d for s in own for d in s), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rids[a : a + 128], np.int64), [len(s) for s in own])), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["rid", "d1", "d2"])

    return digests


def _cutter(by: str, min_words: int):
    """A function of a text, the digests that earlier rows hold (halves as longs), and whether the row is the first of its equals."""
    @F.arrow_udf("struct<text:string,removed:array<struct<start:int,end:int>>>")
    def cutter(texts: pa.Array, late: pa.Array, firsts: pa.Array) -> pa.Array:
        # the digests of all rows as one buffer; a row at a time becomes objects
        size, out = pa.compute.list_value_length(late).fill_null(0).to_numpy(), []
        held = late.flatten()
        keys = np.stack([held.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)], 1).astype("<i8").tobytes() if len(held) else b""
        ends = 16 * np.cumsum(size)
        for k, (text, first) in enumerate(zip(texts, firsts.to_pylist(), strict=True)):
            text, spans = text.as_py(), []
            if text:
                drop = {keys[i : i + 16] for i in range(ends[k] - 16 * size[k], ends[k], 16)}
                if not first:  # an equal row stood before: every run did
                    drop.update(d for r in units(text, by, min_words)[1] if r for _, d in r)
                text, spans = cut(text, drop, by, min_words)
            out.append({"text": text, "removed": [{"start": a, "end": b} for a, b in spans]})
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(span))]))

    return cutter


def _ranked(docs: DataFrame, id_col: str) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``) with ``rid`` (long): unique per distinct row, in rank order (id, nulls last; then row key), and ``first``.

    Unique ids are their own rank. Otherwise the distinct keys are sorted into a written table and
    joined back; of rows equal in every column, one is the first.
    """
    ident = F.col(f"`{id_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if docs.groupBy(ident.alias("i")).count().where("count > 1 or i is null").isEmpty():
        return docs.select(row, ident.cast("long").alias("rid"), F.lit(True).alias("first"))
    keyed = docs.select(row, ident.alias("i"), *row_key(docs))
    keys = keyed.groupBy("i", "_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("i").isNull(), F.col("i"), F.col("_k1"), F.col("_k2")]
    keys = spool(keys.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
                 .withColumn("rid", F.monotonically_increasing_id()).drop("i"), "ranks")
    single = keyed.join(keys.where("n = 1").drop("n"), ["_k1", "_k2"]).select("row", "rid", F.lit(True).alias("first"))
    # equal rows are counted, so that one can be told from the rest
    several = keyed.join(keys.where("n > 1").select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
    several = several.join(keys.where("n > 1"), ["_k1", "_k2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return single.union(several.select("row", "rid", F.col("copy") == 1))


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated units cut from its texts, plus ``removed``: their offsets in the original text.

    ``removed`` holds (start, end) in characters, end exclusive, neighbours merged. Rows, null and
    empty texts and other columns stay (``n_chars``, where there is one, becomes the new length;
    a column named ``removed`` is replaced). Rows rank by integer id, nulls last, ties by a hash
    of the row; of rows equal in every column one keeps its units and the others lose all that
    are compared. A digest is reduced to one row a task before it is shuffled, and the
    occurrences of a hot one are joined as a skewed key, so no task needs all of them.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c != "removed"]
    rows = _ranked(docs.select(*[F.col(f"`{c}`") for c in names]), id_col).withColumn("text", F.col("row").getField(text_col).cast("string"))
    digests = spool(rows.where("first and length(text) > 0").select("rid", "text").mapInArrow(_digests(by, min_words), "rid long, d1 long, d2 long"), "unit-digests")
    repeated = spool(digests.groupBy("d1", "d2").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-units")
    late = digests.join(repeated, ["d1", "d2"]).where("rid != first").groupBy("rid").agg(F.collect_list(F.struct("d1", "d2")).alias("late"))
    done = rows.join(late, "rid", "left").select("row", _cutter(by, min_words)(F.col("text"), F.col("late"), F.col("first")).alias("done"))
    out = {c: F.col("row").getField(c) for c in names}
    out[text_col] = F.col("done.text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("done.removed") > 0, F.length("done.text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return done.select(*[c.alias(n) for n, c in out.items()], F.col("done.removed").alias("removed"))
