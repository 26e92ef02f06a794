"""Chat formatting: logged snapshots that a longer conversation contains are collapsed, the rest rendered.

DataFrame functions only. Turn hashes are combined by exclusive or into rolling prefix hashes
(a turn's hash covers its place), so a conversation is hashed in blocks of turns: a prefix is
the blocks before it and the turns before it in its own block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import spool

#: Turns in a block.
BLOCK = 64


def turn_prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each turn with its place in the conversation and the hash of the conversation up to it.

    Out: ``conv_id``, ``n`` (from 1), ``role``, ``text``, ``h1``, ``h2`` (128 bits of the prefix of
    n turns). Turns are ordered by turn number (nulls last), role and text (nulls first); rows
    without a conversation id are left out, and null roles and texts are told from empty ones.
    Rows that repeat a whole turn are one logged twice and count once. Blocks of turn numbers
    are numbered and hashed apart, so a conversation of very many turns is split over tasks.
    """
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text")).where("conv_id is not null")
    # dealt once by block, as all that follows wants it
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62))).repartition("conv_id", "block").distinct()
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy("conv_id").orderBy("block")
    sizes = sizes.select("conv_id", "block", (F.sum("size").over(before) - F.col("size")).alias("base"))
    within = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = rows.join(sizes, ["conv_id", "block"]).withColumn("n", F.col("base") + F.row_number().over(within)).drop("base")
    parts = ["n", F.isnull("role"), "role", F.isnull("text"), "text"]
    hashed = placed.withColumn("t1", F.xxhash64(F.lit(1), *parts)).withColumn("t2", F.xxhash64(F.lit(2), *parts))
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0).cast("long")).alias(b) for b in ("b1", "b2")])
    upto = W.partitionBy("conv_id", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return hashed.join(sums, ["conv_id", "block"]).select(
        "conv_id", "n", "role", "text", *[F.bit_xor(f"t{k}").over(upto).bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """One row for each maximal conversation: ``conv_id``, ``n_turns`` and ``n_copies``.

    Of conversations with the same turns the smallest id stands for all (``n_copies``). One whose
    turns are the first turns of a longer conversation is a snapshot of it and goes: an
    anti-join of whole hashes with the distinct proper-prefix hashes.
    """
    ends = prefixes.groupBy("conv_id").agg(F.max("n").alias("n"))
    whole = prefixes.select("conv_id", "n", "h1", "h2").join(ends, ["conv_id", "n"])
    classes = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = prefixes.select("conv_id", "n", "h1", "h2").join(ends.withColumnRenamed("n", "n_turns"), "conv_id").where("n < n_turns").select("n", "h1", "h2").distinct()
    return classes.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>", **columns) -> DataFrame:
    """Maximal conversations as training text: ``conv_id``, ``n_turns``, ``n_copies``, ``rendered``.

    Every turn is ``begin`` + role + newline + text + ``end``, and turns are joined by newlines; a
    null role or text is empty. Other columns are not read, and an empty table gives none. The
    text of one conversation is one value, so it has to fit one row.
    """
    # written once: the collapse reads its hashes, the rendering its texts
    prefixes = spool(turn_prefixes(turns, **columns), "chat-prefixes")
    kept = spool(maximal_conversations(prefixes), "chat-kept")
    turn = F.concat(F.lit(begin), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end))
    lines = prefixes.select("conv_id", "n", turn.alias("line")).join(kept, "conv_id")
    texts = lines.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return texts.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "\n").alias("rendered"))


#: DuckDB text for ``render`` over the table ``conversations``: snapshots by comparing whole prefixes.
ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id,
         list({'r': role, 't': text} ORDER BY turn ASC NULLS LAST, role ASC NULLS FIRST, text ASC NULLS FIRST) AS turns
  FROM t GROUP BY conv_id
), k AS (
  SELECT turns, len(turns) AS n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns
), p AS (
  SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM c)
)
SELECT conv_id, n AS n_turns, n_copies,
       array_to_string(list_transform(turns, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>'), chr(10)) AS rendered
FROM k WHERE turns NOT IN (SELECT turns FROM p)
"""
