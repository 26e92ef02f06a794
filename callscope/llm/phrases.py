"""Phrase collocations by dynamic itemset counting: all lengths counted in the same cyclic scans of the corpus shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import bitmap, prepare, remove_path, shared_path, spool, spool_to

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: A candidate goes if a longer one holds it at least this often, in percent of its own count.
COVERED = 100
#: Shards of the corpus (a full cycle scans each once), words meant for a block, bytes of a text that are split at once.
SHARDS, BLOCK_WORDS, SLICE = 3, 1 << 20, 1 << 22
#: Least and most slots (of one byte) of the table of known phrases.
LEAST_SLOTS, MOST_SLOTS = 1 << 15, 1 << 26

_BREAK = b"."
_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _BREAK * 10)
_TOKEN = re.compile(rb"[^\x20\x09.]+|\.")
_SPACE = re.compile(rb"[\x20\x09.]")
_BLOCK = "shard int, lang string, n long, words binary, ids binary"
_COUNT = "lang string, phrase binary, done int, f long"
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Words of one language, numbered as they come; 0 is a break, a negative number is there only to end earlier phrases."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.n = 0
        self.ids = _Ids()

    def add(self, words: list[bytes], ahead: bool = False) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.n += 0 if ahead else int(np.count_nonzero(ids))
        self.parts.append(-ids if ahead else ids)


class _Ids(dict):
    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _slices(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """Slices of a text that end between words, each with the place where the next one starts."""
    a = 0
    while a < len(raw):
        cut = _SPACE.search(raw, a + SLICE)
        b = cut.start() if cut else len(raw)
        yield raw[a:b], b
        a = b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as blocks of word numbers, dealt over the shards in turn."""
    task, made = TaskContext.get(), 0
    open_: dict[str, Block] = {}

    def row(lang: str) -> pa.RecordBatch:
        nonlocal made
        block = open_.pop(lang)
        made += 1
        return pa.RecordBatch.from_arrays([
            pa.array([((task.partitionId() if task else 0) + made) % SHARDS], pa.int32()), pa.array([lang]), pa.array([block.n], pa.int64()),
            pa.array([b" ".join(islice(block.ids, 1, None))], pa.binary()), pa.array([np.concatenate(block.parts).astype("<i4").tobytes()], pa.binary()),
        ], names=["shard", "lang", "n", "words", "ids"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            raw = text.lower().translate(_BREAKS)
            for part, end in _slices(raw):
                block = open_.setdefault(lang, Block())
                block.add(part.replace(_BREAK, b" . ").split(None))
                if block.n >= BLOCK_WORDS:
                    block.add([m[0] for m in islice(_TOKEN.finditer(raw, end), LONGEST - 1)], ahead=True)
                    block.add([_BREAK])
                    yield row(lang)
            if lang in open_:
                open_[lang].add([_BREAK])
            if sum(b.n for b in open_.values()) >= 2 * BLOCK_WORDS:
                yield row(max(open_, key=lambda x: open_[x].n))
    for lang in list(open_):
        yield row(lang)


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its first part and its last word's."""
    h = (h ^ (h >> np.uint64(29))) * _HASH + word
    return h ^ (h >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]) -> list[int]:
    prefix = lang.encode(errors="surrogatepass") + b"\x00"
    return [xxhash.xxh64_intdigest(prefix + w) for w in words]


@F.pandas_udf(T.LongType())
def _phrase_hashes(langs: pd.Series, phrases: pd.Series) -> pd.Series:
    out = []
    for lang, phrase in zip(langs, phrases, strict=True):
        h, *rest = (np.array([x], np.uint64) for x in _word_hashes(lang, bytes(phrase).split(b" ")))
        for word in rest:
            h = _mixed(h, word)
        out.append(h[0])
    return pd.Series(np.array(out, np.uint64).view(np.int64))


def _look(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step in which a phrase of each hash's slot was first known; 0: none is."""
    return table[(h & np.uint64(len(table) - 1)).astype(np.int64)]


def _count(lang: str, words: bytes, ids: bytes, step: int, shards: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts in one block: of its words in the first cycle, and of every phrase in the cycle after its subphrases were known."""
    vocab = [b"", *words.split(b" ")] if words else [b""]
    signed = np.frombuffer(ids, "<i4")
    x, start = np.abs(signed), signed > 0
    hashes = np.array([0, *_word_hashes(lang, vocab[1:])], np.uint64)
    names = pa.array(vocab, pa.binary())

    def rows(phrases: pa.Array, done: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(n), 1 << 16):
            b = min(len(n), a + (1 << 16))
            yield pa.RecordBatch.from_arrays([
                pa.repeat(lang, b - a), phrases[a:b], pa.array(done[a:b].astype(np.int32)), pa.array(n[a:b].astype(np.int64)),
            ], names=["lang", "phrase", "done", "f"])

    if step <= shards:
        n = np.bincount(x[start], minlength=len(vocab))
        used = np.flatnonzero(n)
        yield from rows(names.take(pa.array(used)), np.full(len(used), shards), n[used])
    known = _look(table, hashes)
    known[0] = 0
    known, h = known[x], hashes[x]
    for k in range(2, LONGEST + 1):
        at = np.flatnonzero((known[:-1] > 0) & (known[1:] > 0))
        if not len(at):
            return
        made = _mixed(h[at], hashes[x[at + k - 1]])
        since = np.maximum(known[at], known[at + 1])
        done = since.astype(np.int32) + shards
        count = (done >= step) & start[at]
        p = at[count]
        if len(p):
            key = x[p].astype(np.int64)
            for j in range(1, k):
                if j > 1:
                    key = np.unique(key, return_inverse=True)[1]
                key = key * len(vocab) + x[p + j]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            where = p[first]
            phrases = pc.binary_join_element_wise(*(names.take(pa.array(x[where + j])) for j in range(k)), b" ")
            yield from rows(phrases, done[count][first], n)
        slot = _look(table, made)
        known, h = np.zeros(len(known) - 1, np.uint8), np.zeros(len(known) - 1, np.uint64)
        known[at], h[at] = np.where(slot > 0, np.maximum(slot, since), 0), made  # seen only once its own parts are


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """``lang``, ``phrase`` (binary), ``k`` (words), ``f`` and ``n`` (all words of the language) of each phrase of 1 to 5 words with ``f >= min_count``.

    Step t scans shard t mod ``SHARDS``. It counts words in the first cycle, and a longer phrase
    from the step after both its subphrases (all words but the last, all but the first) are known
    to be frequent, for one full cycle. A phrase becomes known in the step in which its counts so
    far reach ``min_count``; lengths therefore overlap in time, and the scans end when no phrase was
    known so late that an extension's cycle is still open.

    Tasks look known phrases up in a table of at most ``MOST_SLOTS`` bytes, whatever the corpus
    holds: a slot has the step in which the first phrase of that slot was known, and keeps it. A
    phrase counts as known since the latest step in its own slot and those of its parts, so its
    extensions' cycles depend on words alone. Where slots are shared a cycle opens too early, but
    it always is a full one, so counts are exact. A phrase whose cycle is over without enough
    occurrences is dropped from the running counts.
    """
    spark = docs.sparkSession
    prepare(spark)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    path = shared_path(spark, "phrase-blocks")
    shards = SHARDS
    texts.mapInArrow(_blocks, _BLOCK).write.partitionBy("shard").parquet(path)
    blocks = spark.read.schema("lang string, n long, words binary, ids binary, shard int").parquet(path)
    total = spool(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    most = total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // min_count * 4  # frequent phrases of any one length, times four
    table = np.zeros(min(MOST_SLOTS, max(LEAST_SLOTS, 1 << int(most).bit_length())), np.uint8)

    state, old, step, latest = None, None, 0, 0
    while True:
        step += 1
        sent = spark.sparkContext.broadcast(table)

        def scan(batches, sent=sent, step=step):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _count(*(batch[c][i].as_py() for c in ("lang", "words", "ids")), step, shards, sent.value)

        rows = blocks.where(F.col("shard") == step % shards).select("lang", "words", "ids").mapInArrow(scan, _COUNT).withColumn("reach", F.lit(None).cast("int"))
        if state is not None:
            rows = rows.union(state)
        merged = rows.groupBy("lang", "phrase").agg(F.max("done").alias("done"), F.sum("f").alias("f"), F.max("reach").alias("reach"))
        merged = merged.withColumn("reach", F.coalesce("reach", F.when(F.col("f") >= min_count, F.lit(step))))
        state, now = spool_to(merged.where((F.col("f") >= min_count) | (F.col("done") > step)), "phrase-counts")
        if old:
            remove_path(spark, old)
        old = now
        sent.destroy()
        short = F.size(F.split(F.col("phrase").cast("string"), " ")) < LONGEST
        new = bitmap(state.where((F.col("reach") == step) & short).select(_phrase_hashes("lang", "phrase").alias("h")), len(table))
        latest = step if new.any() else latest
        table[np.unpackbits(new, bitorder="little", count=len(table)).view(bool) & (table == 0)] = min(step, 255 - shards)
        if step >= shards and latest <= step - shards:
            break
    return state.where("reach is not null").select(
        "lang", "phrase", F.size(F.split(F.col("phrase").cast("string"), " ")).alias("k"), "f").join(total, "lang")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 to 5 words of each language by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest cut, ``n`` all words of
    the language; the score is floor(1000 a n / (l r)), exact up to 38 digits. A phrase that a longer
    candidate always holds is left out. Null languages are ``und``, null and empty texts have no
    words, repeated rows count each time, texts of any length are counted whole; an empty table, or
    one without a frequent phrase, gives no rows; other columns are ignored. Equal scores rank by
    count, then by the phrase's bytes.
    """
    counted = spool(count_phrases(docs, lang_col, text_col, min_count), "phrases")
    words = F.split(F.col("phrase").cast("string"), " ")
    longer = counted.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), "n", words.alias("words"))

    def joined(a, size):
        return F.array_join(F.slice("words", a, size), " ").cast("binary")

    parts = counted.select("lang", F.col("phrase").alias("part"), "f")
    cut = longer.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cut = cut.select("lang", "phrase", "a", "n", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cut = (cut.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
           .join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr("(cast(a as decimal(18, 0)) * 1000 * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    inner = longer.where("k > 2").withColumn("size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - size + 1)")))
    held = inner.groupBy("lang", joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("held"))
    left = scored.join(held, ["lang", "phrase"], "left").where(f"held is null or 100 * held < {COVERED} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(f"place <= {top}")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    return ranked.select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


#: DuckDB: every phrase of 1 to 5 words is counted.
ORACLE = f"""
WITH pieces AS (
  SELECT lang, unnest(list_transform(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]'), lambda p: list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> ''))) AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (SELECT lang, words, i, k FROM starts, range(1, {LONGEST + 1}) s(k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
longer AS (SELECT lang, phrase, k, f AS a, n, string_split(phrase, ' ') AS w FROM f JOIN n USING (lang) WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.n, cut, x.f AS l, y.f AS r, (1000::HUGEINT * c.a * c.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM longer) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM longer WHERE k > 2)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE held IS NULL OR 100 * held < {COVERED} * a)
WHERE rank <= {TOP}
"""
