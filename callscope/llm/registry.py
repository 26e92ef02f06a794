"""The queries of this subpackage and their DuckDB texts (where SQL can express them)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from callscope.llm import (
    byte_bpe,
    chat,
    decontaminate,
    html_text,
    neighbours,
    phrases,
    shingle_join,
    simhash,
    substring_dedup,
    token_ids,
    toxicity,
    trie,
    url_inputs,
    url_lists,
)
from callscope.llm.common import prepare, shared_path, table


def op1_token_ids(spark, sf_dir):
    """Write all documents' token ids with Elias-Fano boundaries, read them back: place, length and checksum of each."""
    path = shared_path(spark, "token-ids")
    token_ids.write_token_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)
    return token_ids.read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_decontaminate(spark, sf_dir):
    """Words, hit words and leaking items of every document, for all benchmark items."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans")


def op3_url_lists(spark, sf_dir):
    """Verdict for every page's capture by the list entries active at its fetch time."""
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    return url_lists.judge(url_inputs.captures(pages), url_inputs.list_changes(pages))


def op4_html_text(spark, sf_dir):
    """Main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_neighbours(spark, sf_dir):
    """The ten nearest of all vectors for each query (ids divisible by 100), through the posting lists."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op6_byte_bpe(spark, sf_dir):
    """Encode all documents with byte-level BPE, decode the ids: their number and the digests of both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)


def op7_chat(spark, sf_dir):
    """All maximal conversations, rendered."""
    prepare(spark)
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_substring_dedup(spark, sf_dir):
    """All documents without repeated sentences: what stays, and the offsets of what went."""
    done = substring_dedup.drop_repeated_units(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", F.length("text").cast("long").alias("n_kept"), "text")


def op9_simhash(spark, sf_dir):
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark, sf_dir):
    """Toxicity score of every document by the classifier trained on the labels outside the held-out part."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrases(spark, sf_dir):
    """The best 2,000 phrases of each language by their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    """All nodes of the prefix trie of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_shingle_join(spark, sf_dir):
    """Size of every document's shingle set and the class that similar sets make."""
    return shingle_join.join_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_ids, op2_decontaminate, op3_url_lists, op4_html_text, op5_neighbours, op6_byte_bpe, op7_chat, op8_substring_dedup, op9_simhash, op10_toxicity,
    op11_phrases, op12_prefix_trie, op13_shingle_join)}
ORACLES: dict[str, str] = {"op3_url_lists": url_inputs.ORACLE, "op7_chat": chat.ORACLE, "op11_phrases": phrases.ORACLE, "op12_prefix_trie": trie.ORACLE}


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
