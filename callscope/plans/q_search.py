"""Registered full-text search queries (E1-E4, C1, C14) over ``documents`` and the calls view."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import search as se
from callscope.operators.search_index import SearchIndex
from callscope.plans.catalog import calls, register
from callscope.session import scratch_dir
from callscope.sources.fixtures import read_table

DOC_COLS = ["text"]
DOC_QUERY = "worthless of-the"
CALL_QUERY = "gpt-4o OPENAI"
TOKEN_RE = r"[\p{L}\p{N}]+"


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _doc_index(spark, sf):
    d = _docs(spark, sf)
    return se.token_index(d, "doc_id", DOC_COLS), se.doc_lengths(d, "doc_id", DOC_COLS)


def _tok(expr: str) -> str:
    return f"coalesce(regexp_extract_all(strip_accents(lower({expr})), '{TOKEN_RE}'), [])"


def _index_sql(table: str, id_col: str, cols: list[str], where: str = "") -> str:
    parts = [f"SELECT {id_col} AS id, '{c}' AS col, {_tok(c)} AS toks FROM {table} {where}" for c in cols]
    return (f"SELECT id, col, CAST(i - 1 AS INTEGER) AS pos, toks[i] AS token FROM ({' UNION ALL '.join(parts)}) x, "
            f"generate_series(1, len(toks)) g(i) WHERE len(toks) > 0")


def _lengths_sql(table: str, id_col: str, cols: list[str]) -> str:
    return f"SELECT {id_col} AS id, " + " + ".join(f"len({_tok(c)})" for c in cols) + f" AS doc_len FROM {table}"


def _phrases_sql(phrases) -> str:
    vals = ", ".join(f"({i}, {j}, '{t}', {len(p)})" for i, p in enumerate(phrases) for j, t in enumerate(p))
    return f"(SELECT * FROM (VALUES {vals}) t(phrase, term_no, token, plen))"


def _tf_sql(index_sql: str, phrases) -> str:
    return f"""SELECT id, phrase, count(*) AS tf FROM (
      SELECT ix.id, ix.col, q.phrase, ix.pos - q.term_no AS start, count(*) AS m, any_value(q.plen) AS plen
      FROM ({index_sql}) ix JOIN {_phrases_sql(phrases)} q ON ix.token = q.token
      GROUP BY ALL HAVING count(*) = any_value(q.plen)) GROUP BY id, phrase"""


def _bm25_sql(index_sql: str, lengths_sql: str, query: str) -> str:
    phrases = se.parse_query(query)
    np_ = len(phrases)
    return f"""WITH tf AS ({_tf_sql(index_sql, phrases)}),
      ln AS ({lengths_sql}),
      st AS (SELECT count(*)::DOUBLE AS n, sum(doc_len)::DOUBLE AS t FROM ln),
      dfq AS (SELECT phrase, count(*)::DOUBLE AS nd FROM tf GROUP BY phrase),
      idf AS (SELECT dfq.phrase, CASE WHEN ln((st.n - nd + 0.5::DOUBLE) / (nd + 0.5::DOUBLE)) > 0
                THEN ln((st.n - nd + 0.5::DOUBLE) / (nd + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf
              FROM dfq, st),
      full_ids AS (SELECT id FROM tf GROUP BY id HAVING count(*) = {np_})
    SELECT tf.id, -sum(idf.idf * (tf.tf::DOUBLE * (1.2::DOUBLE + 1.0::DOUBLE)) / (tf.tf::DOUBLE + 1.2::DOUBLE *
        (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * ln.doc_len::DOUBLE / (st.t / st.n)))) AS rank
    FROM tf JOIN full_ids USING (id) JOIN ln USING (id) JOIN idf USING (phrase), st GROUP BY tf.id"""


_DOC_INDEX = _index_sql("documents", "doc_id", DOC_COLS)
_DOC_LENGTHS = _lengths_sql("documents", "doc_id", DOC_COLS)


@register("token_index", _DOC_INDEX, calls_cte=False)
def q_token_index(spark, sf):
    """Token occurrence table of every document (lower-cased, diacritics folded)."""
    return _doc_index(spark, sf)[0]


@register("doc_lengths", _DOC_LENGTHS, calls_cte=False)
def q_doc_lengths(spark, sf):
    """Per-document token counts used by BM25 length normalisation."""
    return _doc_index(spark, sf)[1]


@register("phrase_match", _tf_sql(_DOC_INDEX, se.parse_query(DOC_QUERY)), calls_cte=False)
def q_phrase_match(spark, sf):
    """Occurrences per document of each phrase of the query (adjacent tokens in order)."""
    idx, _ = _doc_index(spark, sf)
    return se.phrase_match(idx, se.parse_query(DOC_QUERY))


@register("search", f"""WITH s AS ({_bm25_sql(_DOC_INDEX, _DOC_LENGTHS, DOC_QUERY)}),
  top AS (SELECT * FROM s ORDER BY rank, id LIMIT 20)
  SELECT d.doc_id, d.lang, d.source, round(top.rank, 9) AS rank FROM documents d JOIN top ON d.doc_id = top.id""",
          calls_cte=False)
def q_search(spark, sf):
    """E3 + C1: BM25 top-20 documents for a two-phrase query, joined back to the documents."""
    idx, lens = _doc_index(spark, sf)
    return se.search(_docs(spark, sf), idx, lens, DOC_QUERY, 20, "doc_id").select(
        "doc_id", "lang", "source", "rank")


@register("rank_topk", f"""SELECT id, round(rank, 9) AS rank FROM ({_bm25_sql(_DOC_INDEX, _DOC_LENGTHS, "the of-the")})
  ORDER BY rank, id LIMIT 100""", calls_cte=False)
def q_rank_topk(spark, sf):
    """Best 100 BM25 hits for a common-word query (distributed top-k)."""
    idx, lens = _doc_index(spark, sf)
    return se.bm25_scores(idx, lens, "the of-the").orderBy("rank", "id").limit(100)


_CALL_INDEX = _index_sql("calls", "id", se.INDEXED_CALL_COLUMNS)
_CALL_LENGTHS = _lengths_sql("calls", "id", se.INDEXED_CALL_COLUMNS)


@register("search_calls", f"""WITH s AS ({_bm25_sql(_CALL_INDEX, _CALL_LENGTHS, CALL_QUERY)}),
  top AS (SELECT * FROM s ORDER BY rank, id LIMIT 50)
  SELECT c.id, c.model, c.provider, c.endpoint, round(top.rank, 9) AS rank FROM calls c JOIN top USING (id)""")
def q_search_calls(spark, sf):
    """E3 over the calls: 'gpt-4o' (phrase gpt,4o) and 'openai' across the 8 indexed columns."""
    c = calls(spark, sf)
    idx, lens = se.token_index(c), se.doc_lengths(c)
    return se.search(c, idx, lens, CALL_QUERY, 50).select("id", "model", "provider", "endpoint", "rank")


def _snippet_sql() -> str:
    phrases = se.parse_query(DOC_QUERY)
    first = phrases[0]
    return f"""WITH s AS ({_bm25_sql(_DOC_INDEX, _DOC_LENGTHS, DOC_QUERY)}),
  top AS (SELECT * FROM s ORDER BY rank, id LIMIT 20),
  occ AS (SELECT ix.id, ix.pos - q.term_no AS start FROM ({_DOC_INDEX}) ix
          JOIN {_phrases_sql([first])} q ON ix.token = q.token
          WHERE ix.col = 'text' GROUP BY ix.id, ix.pos - q.term_no HAVING count(*) = {len(first)}),
  hit AS (SELECT id, min(start) AS h FROM occ GROUP BY id),
  d AS (SELECT d.doc_id, top.rank, coalesce(regexp_extract_all(d.text, '{TOKEN_RE}'), []) AS toks,
               greatest(coalesce(hit.h, 0) - 3, 0) AS st
        FROM documents d JOIN top ON d.doc_id = top.id LEFT JOIN hit ON hit.id = d.doc_id)
  SELECT doc_id, round(rank, 9) AS rank,
    CASE WHEN st > 0 THEN '...' ELSE '' END || array_to_string(list_slice(toks, st + 1, st + {se.SNIPPET_TOKENS}), ' ')
    || CASE WHEN st + {se.SNIPPET_TOKENS} < len(toks) THEN '...' ELSE '' END AS snippet FROM d"""


@register("snippet", _snippet_sql(), calls_cte=False)
def q_snippet(spark, sf):
    """12-token excerpts around the first hit for the top-20 documents."""
    d = _docs(spark, sf)
    idx, lens = _doc_index(spark, sf)
    hits = se.search(d, idx, lens, DOC_QUERY, 20, "doc_id")
    return se.with_snippet(hits, DOC_QUERY, "text").select("doc_id", "rank", "snippet")


@register("index_backfill", _index_sql("documents", "doc_id", DOC_COLS, "WHERE lang <> 'en'"), calls_cte=False)
def q_index_backfill(spark, sf):
    """C14: index only documents not yet in an index that already holds the English documents."""
    d = _docs(spark, sf)
    existing = se.doc_lengths(d.where(F.col("lang") == "en"), "doc_id", DOC_COLS)
    return se.index_backfill(d, existing, "doc_id", DOC_COLS)


@register("search_join", f"""WITH s AS ({_bm25_sql(_CALL_INDEX, _CALL_LENGTHS, "claude anthropic")}),
  top AS (SELECT * FROM s ORDER BY rank, id LIMIT 100)
  SELECT c.*, round(top.rank, 9) AS rank FROM calls c JOIN top USING (id)""", raw=True)
def q_search_join(spark, sf):
    """BM25 hits of a calls search joined back to the full call records."""
    from callscope.plans.catalog import round_double

    c = calls(spark, sf)
    idx, lens = se.token_index(c), se.doc_lengths(c)
    out = se.search(c, idx, lens, "claude anthropic", 100)
    return out.withColumn("rank", round_double(F.col("rank")))


def _grown_index(spark, sf):
    """A written index that grew by three batches; the second and third also bring records that it already has."""
    d = _docs(spark, sf)
    index = SearchIndex(spark, scratch_dir(spark, "segments"), "doc_id", DOC_COLS, 16)
    for batch in (d.where("lang = 'en'"), d.where("lang in ('en', 'de')"), d):
        index.add(batch)
    return index


@register("segment_postings", f"""SELECT token, id, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos
  FROM ({_DOC_INDEX}) GROUP BY token, id""", calls_cte=False)
def q_segment_postings(spark, sf):
    """Positional postings of an index that grew by batches, all segments read as one."""
    return _grown_index(spark, sf).postings().select(
        "token", "id", F.col("tf").cast("long").alias("tf"), F.get("positions", F.lit(0)).alias("first_pos"),
        F.get("positions", F.col("tf") - 1).alias("last_pos"))


@register("segment_search", f"""WITH s AS ({_bm25_sql(_DOC_INDEX, _DOC_LENGTHS, DOC_QUERY)}),
  top AS (SELECT * FROM s ORDER BY rank, id LIMIT 20)
  SELECT d.doc_id, d.lang, d.source, round(top.rank, 9) AS rank FROM documents d JOIN top ON d.doc_id = top.id""",
          calls_cte=False)
def q_segment_search(spark, sf):
    """E3 over the segments of a grown index: phrases by intersection of positions."""
    return _grown_index(spark, sf).search(_docs(spark, sf), DOC_QUERY, 20).select("doc_id", "lang", "source", "rank")


@register("segment_topk", f"""SELECT id, round(exact, 9) AS rank FROM (
  SELECT id, rank AS exact FROM ({_bm25_sql(_DOC_INDEX, _DOC_LENGTHS, "the")}) ORDER BY exact, id LIMIT 100)""", calls_cte=False)
def q_segment_topk(spark, sf):
    """Best 100 hits of a frequent word; only impact blocks that can hold one of them are read."""
    return _grown_index(spark, sf).top("the", 100)
