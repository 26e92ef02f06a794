"""Full-text phrase search with BM25 ranking.

Index in memory: one row per token occurrence ``(id, col, pos, token)`` plus a
per-row length table ``(id, doc_len)``. Written indexes (``search_index.py``) have
one row per token and record with its positions, hash-bucketed by token
(``bucket = pmod(xxhash64(token), B)``), so a query reads only the buckets of its terms.

Query semantics: the query splits on whitespace; each piece is a phrase
(its tokens must be adjacent, in order, within one column); a row matches
when it contains every phrase. Rank = -BM25 (k1 = 1.2, b = 0.75), summed
over phrases, idf = ln((N - n + 0.5) / (n + 0.5)) floored at 1e-6; lower
rank is better.

Phrase matching in memory uses position alignment instead of a chain of self-joins:
a hit of term ``t`` (term number ``j``) at position ``p`` votes for a phrase
start ``p - j``; a start with as many votes as the phrase has terms is an
occurrence. That is one filter, one broadcast join with the tiny query
table and one aggregate, whatever the phrase length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.text import TOKEN_PATTERN, normalize, py_tokens, raw_tokens, tokens
from callscope.operators.filters import _limit

# Columns of a call that are searchable, BM25 parameters,
# and snippet width.
INDEXED_CALL_COLUMNS = ["model", "provider", "endpoint", "request_body", "response_body",
                        "error", "tags", "agent_name"]
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
SNIPPET_TOKENS = 12
DEFAULT_BUCKETS = 64


def token_index(df: DataFrame, id_col: str = "id", columns=INDEXED_CALL_COLUMNS) -> DataFrame:
    """``(id, col, pos, token)`` for every token of every indexed column."""
    per_col = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("toks")) for c in columns])
    return (df.select(F.col(id_col).alias("id"), F.explode(per_col).alias("x"))
            .select("id", F.col("x.col").alias("col"), F.posexplode("x.toks").alias("pos", "token")))


def doc_lengths(df: DataFrame, id_col: str = "id", columns=INDEXED_CALL_COLUMNS) -> DataFrame:
    """``(id, doc_len)``: token count over all indexed columns (every row, even empty ones).

    Counts regex matches without materialising the token arrays.
    """
    n = None
    for c in columns:
        s = F.coalesce(F.regexp_count(normalize(F.col(c)), F.lit(TOKEN_PATTERN)), F.lit(0))
        n = s if n is None else n + s
    return df.select(F.col(id_col).alias("id"), n.cast("long").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> tuple[int, float]:
    """(row count, total tokens) of the indexed corpus: one aggregate row."""
    r = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("t")).first()
    return int(r["n"] or 0), float(r["t"] or 0.0)


#: Tokens of records that are cut into postings at a time (a longer record is cut by itself), and bytes of records that a Python worker is sent at a time.
TOKENS_CUT, BYTES_SENT = 1 << 18, 4 << 20


def _posting_batches(n_columns: int):
    """Token arrays of records to postings: whole-array sorting and run cutting, no loop over tokens.

    Some ``TOKENS_CUT`` tokens at a time, so that the memory depends neither on the number of records nor on the batches they come in.
    """

    def cut(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n, rows, places, flat = batch.num_rows, [], [], []
        for k in range(n_columns):
            lists = batch.column(k + 1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append(np.repeat(np.arange(n), size))
            places.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + (k << 32))
            flat.append(lists.flatten())
        row, place, tokens = np.concatenate(rows), np.concatenate(places), pa.concat_arrays(flat).dictionary_encode()
        if not len(row):
            return
        code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(row * len(tokens.dictionary) + code, kind="stable")  # places stay ascending
        row, code, place, length = row[order], code[order], place[order], np.bincount(row, minlength=n)
        starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
        ends, own = np.append(starts[1:], len(row)), row[starts]
        lead = np.concatenate([[True], own[1:] != own[:-1]])
        for i in range(0, len(starts), 1 << 14):
            j = min(len(starts), i + (1 << 14))
            offsets = pa.array(np.append(starts[i:j], ends[j - 1]) - starts[i], pa.int32())
            yield pa.RecordBatch.from_arrays([
                tokens.dictionary.take(pa.array(code[starts[i:j]])), batch.column(0).take(pa.array(own[i:j])), pa.array(ends[i:j] - starts[i:j], pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(place[starts[i] : ends[j - 1]])), pa.array(length[own[i:j]]), pa.array(lead[i:j]),
            ], names=["token", "id", "tf", "positions", "doc_len", "lead"])

    def made(batches):
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            size = sum(pc.list_value_length(batch.column(k + 1)).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_columns))
            part = (np.cumsum(size) - 1) // TOKENS_CUT
            bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), batch.num_rows]
            for i, j in zip(bounds, bounds[1:], strict=False):
                yield from cut(batch.slice(i, j - i))

    return made


def postings(df: DataFrame, id_col: str = "id", columns=INDEXED_CALL_COLUMNS) -> DataFrame:
    """Positional postings, one row per token and record: ``token``, ``id``, ``tf``, ``positions``, ``doc_len``, ``lead``.

    A position is the column's number in the upper 32 bits and the token's place in the lower, so
    neighbours in one column are neighbours in number and a phrase is an intersection of shifted
    arrays. Every column is tokenised once, and the records of a batch are cut into postings as
    arrays (Arrow and numpy; the same by array functions took over twice the time); nothing is
    shuffled. ``lead`` marks one row per record that has tokens.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(columns)])
    return rows.mapInArrow(_posting_batches(len(columns)), f"token string, id {kind}, tf int, positions array<bigint>, doc_len bigint, lead boolean")


def write_index(df: DataFrame, path: str, id_col: str = "id", columns=INDEXED_CALL_COLUMNS,
                buckets: int = DEFAULT_BUCKETS) -> tuple[str, str]:
    """Build and persist an index anew, as the only segment of the one at ``path``.

    Returns (index_path, lengths_path), for ``read_index`` and ``read_stats``.
    """
    from callscope.operators.search_index import SearchIndex

    SearchIndex(df.sparkSession, path, id_col, columns, buckets).replace(df)
    return f"{path}/postings", f"{path}/lengths"


def read_index(spark: SparkSession, ipath: str, lpath: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of all segments of a persisted index."""
    from callscope.operators.search_index import SearchIndex

    index = SearchIndex(spark, ipath.rsplit("/", 1)[0])
    return index.postings(), index.lengths()


def read_stats(spark: SparkSession, ipath: str) -> tuple[int, float, int]:
    """(row count, total tokens, bucket count) of a persisted index."""
    from callscope.operators.search_index import SearchIndex

    return SearchIndex(spark, ipath.rsplit("/", 1)[0]).stats()


def index_backfill(df: DataFrame, indexed: DataFrame, id_col: str = "id",
                   columns=INDEXED_CALL_COLUMNS) -> DataFrame:
    """C14: index rows only for records whose id is not yet indexed (anti-join).

    ``indexed`` is the length table: one row a record, also for records
    without tokens, so those are not read again at each run.
    """
    have = indexed.select(F.col("id").alias(id_col))
    todo = df.join(have, id_col, "left_anti")
    return token_index(todo, id_col, columns)


def parse_query(query: str) -> list[list[str]]:
    """Whitespace pieces -> phrases (token lists); pieces without tokens are dropped."""
    out = []
    for piece in (query or "").split():
        toks = py_tokens(piece)
        if toks:
            out.append(toks)
    return out


def _query_table(spark: SparkSession, phrases: list[list[str]]) -> DataFrame:
    rows = [(i, j, t, len(p)) for i, p in enumerate(phrases) for j, t in enumerate(p)]
    return spark.createDataFrame(rows, "phrase int, term_no int, token string, plen int")


def token_bucket(term: str, buckets: int) -> int:
    """Bucket of a query term: ``pmod(xxhash64(term), buckets)`` as Spark computes it
    (XXH64 of the UTF-8 bytes, seed 42, read as a signed long)."""
    import xxhash

    h = xxhash.xxh64_intdigest(term.encode("utf-8"), seed=42)
    if h >= 1 << 63:
        h -= 1 << 64
    return h % int(buckets)


def _restrict_buckets(index: DataFrame, terms: list[str], buckets: int | None) -> DataFrame:
    """On a bucketed index, add a literal bucket filter so partitions are pruned."""
    if "bucket" not in index.columns or not buckets:
        return index
    ids = sorted({token_bucket(t, buckets) for t in terms})
    return index.where(F.col("bucket").isin(ids))


def phrase_hits(index: DataFrame, phrases: list[list[str]], buckets: int | None = None) -> DataFrame:
    """Phrase occurrences ``(id, col, phrase, start)``."""
    spark = index.sparkSession
    terms = sorted({t for p in phrases for t in p})
    q = _query_table(spark, phrases)
    cand = _restrict_buckets(index, terms, buckets).where(F.col("token").isin(terms))
    length = ["doc_len"] if "doc_len" in index.columns else []
    return (cand.join(F.broadcast(q), "token")
            .withColumn("start", F.col("pos") - F.col("term_no"))
            .groupBy("id", "col", "phrase", "start")
            .agg(F.count(F.lit(1)).alias("m"), F.first("plen").alias("plen"), *[F.first(c).alias(c) for c in length])
            .where(F.col("m") == F.col("plen"))
            .select("id", "col", "phrase", "start", *length))


def phrase_match(index: DataFrame, phrases: list[list[str]], buckets: int | None = None) -> DataFrame:
    """Per row and phrase, the number of occurrences ``tf`` (and ``doc_len`` where the index has it)."""
    if "positions" in index.columns:
        return _positional_match(index, phrases, buckets)
    length = [F.first("doc_len").alias("doc_len")] if "doc_len" in index.columns else []
    return phrase_hits(index, phrases, buckets).groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("tf"), *length)


def _positional_match(index: DataFrame, phrases: list[list[str]], buckets: int | None) -> DataFrame:
    """Matches by positional postings: a one-token phrase is its posting, a longer one the intersection of its tokens' shifted positions."""
    terms = sorted({t for p in phrases for t in p})
    cand = _restrict_buckets(index, terms, buckets).where(F.col("token").isin(terms)).join(F.broadcast(_query_table(index.sparkSession, phrases)), "token")
    one = cand.where("plen = 1").select("id", "phrase", F.col("tf").cast("long").alias("tf"), "doc_len")
    if all(len(p) == 1 for p in phrases):
        return one
    shifted = F.transform("positions", lambda p: p - F.col("term_no").cast("long")).alias("starts")
    more = cand.where("plen > 1").select("id", "phrase", "plen", "doc_len", shifted).groupBy("id", "phrase").agg(
        F.collect_list("starts").alias("all"), F.first("plen").alias("plen"), F.first("doc_len").alias("doc_len")).where("size(all) = plen")
    starts = F.aggregate(F.slice("all", 2, F.col("plen")), F.get("all", F.lit(0)), F.array_intersect)
    more = more.select("id", "phrase", F.size(starts).cast("long").alias("tf"), "doc_len").where("tf > 0")
    return more if all(len(p) > 1 for p in phrases) else one.unionByName(more)


def bm25_scores(index: DataFrame, lengths: DataFrame, query: str,
                stats: tuple | None = None) -> DataFrame:
    """Every row matching all phrases with its BM25 ``rank`` (more negative = better).

    Corpus size and total tokens are one aggregate row (or the stats stored
    with a persisted index, which also give its bucket count); per-phrase document frequencies are computed in
    the plan and broadcast back (one row per query phrase).
    """
    spark = index.sparkSession
    phrases = parse_query(query)
    if not phrases:
        return spark.createDataFrame([], "id " + index.schema["id"].dataType.simpleString() + ", rank double")
    n_rows, total, *rest = stats if stats is not None else corpus_stats(lengths)
    buckets = rest[0] if rest else None
    avgdl = total / n_rows if n_rows else 1.0
    tf = phrase_match(index, phrases, buckets)
    nd = tf.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("_nd"))
    raw_idf = F.log((F.lit(float(n_rows)) - F.col("_nd") + F.lit(0.5)) / (F.col("_nd") + F.lit(0.5)))
    idf = nd.select("phrase", F.when(raw_idf > 0, raw_idf).otherwise(F.lit(IDF_FLOOR)).alias("_idf"))
    k1, b = F.lit(BM25_K1), F.lit(BM25_B)
    f = F.col("tf").cast("double")
    dl = F.col("doc_len").cast("double")
    norm = F.lit(1.0) - b + b * dl / F.lit(avgdl if avgdl else 1.0)
    term = F.col("_idf") * (f * (k1 + F.lit(1.0))) / (f + k1 * norm)
    # the postings of a written index carry the length; others are joined with the length table
    sized = tf if "doc_len" in tf.columns else tf.join(lengths, "id")
    scored = (sized.join(F.broadcast(idf), "phrase")
              .groupBy("id").agg(F.count(F.lit(1)).alias("_np"), (-F.sum(term)).alias("rank")))
    return scored.where(F.col("_np") == len(phrases)).select("id", "rank")


def search(records: DataFrame, index: DataFrame, lengths: DataFrame, query: str,
           limit: int = 20, id_col: str = "id", stats: tuple | None = None) -> DataFrame:
    """E3 + C1 + G4: best ``limit`` matching records with their rank.

    The top-k is a distributed TakeOrderedAndProject; its ids are joined with the
    records, by broadcast while they are under Spark's threshold.
    """
    k = _limit(limit)
    top = bm25_scores(index, lengths, query, stats).orderBy("rank", "id").limit(k)
    return (records.join(top.withColumnRenamed("id", id_col), id_col)
            .orderBy("rank", id_col))


def with_snippet(hits: DataFrame, query: str, text_col: str) -> DataFrame:
    """A <= 12-token excerpt of ``text_col`` around the first hit of the first phrase.

    Window choice is approximate (starts 3 tokens before the hit); tokens
    keep their original case and are joined by single spaces; ``...`` marks
    cut-offs. Runs only on the result rows.
    """
    phrases = parse_query(query)
    first = phrases[0] if phrases else []
    # the first phrase's first place is read off the hit's own text: the index is not scanned again
    own, n = tokens(F.col(text_col)), len(first)
    found = F.filter(F.sequence(F.lit(0), F.size(own)), lambda i: F.slice(own, i + 1, n) == F.array(*map(F.lit, first))) if first else F.array().cast("array<int>")
    hits = hits.withColumn("_hit", F.try_element_at(found, F.lit(1)))
    toks = raw_tokens(F.col(text_col))
    start = F.greatest(F.coalesce(F.col("_hit"), F.lit(0)) - F.lit(3), F.lit(0))
    piece = F.array_join(F.slice(toks, start + 1, SNIPPET_TOKENS), " ")
    snip = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), piece,
                    F.when(start + SNIPPET_TOKENS < F.size(toks), F.lit("...")).otherwise(F.lit("")))
    return hits.withColumn("snippet", snip).drop("_hit")
