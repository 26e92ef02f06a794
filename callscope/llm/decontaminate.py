"""Benchmark decontamination: an FM-index per shard of documents, searched for benchmark windows."""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import free_name, prepare, spool
from callscope.llm.fm_index import FmIndex

WINDOW = 10
#: Words of a shard (a longer document is a shard of its own).
SHARD_WORDS = 600_000
#: Characters of benchmark texts in a block, and blocks that one pass over the documents takes.
BLOCK_CHARS, PASS_BLOCKS = 1_000_000, 16
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str | None) -> str:
    """A-Z lower-cased; other letters stay."""
    if not text:
        return ""
    return text.lower() if text.isascii() else text.translate(_LOWER)


class Block:
    """Distinct windows of some benchmark items over the numbered words that they hold."""

    def __init__(self, items: list[tuple]):
        self.words: dict[str, int] = {}
        windows: dict[tuple, set] = {}
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in _WORD.findall(_lower(text))]
            for k in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows.setdefault(tuple(ids[k : k + WINDOW]), set()).update(() if name is None else (str(name),))
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.zeros((len(windows), WINDOW), np.int32)
        for row, w in zip(self.patterns, windows, strict=True):
            row[: len(w)] = w
        self.items = list(windows.values())


def block_groups(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark in groups of at most ``PASS_BLOCKS`` pickled blocks, each of at most ``BLOCK_CHARS`` characters (or one item).

    Items are read partition by partition, so the driver holds one group at a time. At least
    one group, which is empty for an empty benchmark; with each, whether it is the last.
    """
    items = benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).where(F.length(F.col(f"`{text_col}`")) > 0).distinct()
    group, held, chars = [], [], 0
    for name, text in items.toLocalIterator():
        if held and chars + len(text) > BLOCK_CHARS:
            group.append(pickle.dumps(Block(held)))
            held, chars = [], 0
            if len(group) == PASS_BLOCKS:
                yield group, False
                group = []
        held.append((name, text))
        chars += len(text)
    yield group + ([pickle.dumps(Block(held))] if held else []), True


class Shard:
    """Words of some documents, end to end."""

    def __init__(self, texts: list[str]):
        self.texts = [_lower(t) for t in texts]
        self.words = [_WORD.findall(t) for t in self.texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.hit = np.zeros(int(self.starts[-1]), bool)
        self.items: dict[int, set] = {}

    def search(self, block: Block) -> None:
        """Mark the words in occurrences of the block's windows, and note the items."""
        total = int(self.starts[-1])
        if not total or not len(block.patterns):
            return
        get = block.words.get
        ids = np.fromiter((get(w, 0) for words in self.words for w in words), np.int32, total)
        # a separator before each document; words that no window holds are separators too, runs of which are one
        owner = np.repeat(np.arange(len(self.words)), self.counts)
        at = np.arange(total) + owner + 1
        text = np.zeros(total + len(self.words) + 1, np.int32)
        text[at] = ids
        place = np.full(len(text), -1, np.int64)
        place[at] = np.arange(total)
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != 0) | (text[:-1] != 0)
        text, place = text[keep], place[keep]
        index = FmIndex(text, len(block.words) + 1)
        low, high = index.search(block.patterns, block.lengths)
        found = np.flatnonzero(low < high)
        number = high[found] - low[found]
        edges = np.zeros(total + 1, np.int32)
        # occurrences in bounded runs of windows
        cut = np.concatenate([[0], np.cumsum(number)])
        a = 0
        while a < len(found):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + 500_000, "right")) - 1)
            windows = np.repeat(found[a:b], number[a:b])
            slots = np.arange(cut[b] - cut[a]) - np.repeat(cut[a:b] - cut[a], number[a:b]) + np.repeat(low[found[a:b]], number[a:b])
            start = place[index.locate(slots)]
            np.add.at(edges, start, 1)
            np.add.at(edges, start + block.lengths[windows], -1)
            pairs = np.unique(owner[start] * len(block.patterns) + windows)
            for doc, window in zip((pairs // len(block.patterns)).tolist(), (pairs % len(block.patterns)).tolist(), strict=True):
                self.items.setdefault(doc, set()).update(block.items[window])
            a = b
        self.hit |= np.cumsum(edges[:-1]) > 0

    def spans(self, doc: int) -> list[tuple[int, int, int, int]]:
        """Merged runs of hit words of a document: first word, end word, first character, end character."""
        hit = self.hit[self.starts[doc] : self.starts[doc + 1]]
        if not hit.any():
            return []
        turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).reshape(-1, 2)
        places = [m.span() for m in _WORD.finditer(self.texts[doc])]
        return [(int(a), int(b), places[a][0], places[b - 1][1]) for a, b in turn]


def _shards(names, texts):
    """Documents in groups of about SHARD_WORDS words (six characters a word)."""
    held, chars = [], 0
    for name, text in zip(names, texts, strict=True):
        held.append((name, text))
        chars += len(text or "")
        if chars >= 6 * SHARD_WORDS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _gathered(batches, first: int):
    """Arrow batches as lists of rows of about one shard; column ``first`` is the text."""
    held, size = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, 128):
            part = batch.slice(a, 128)
            held.append(part)
            size += part.column(first).nbytes
            if size >= 6 * SHARD_WORDS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())])
_SPANS = "array<struct<start:int,end:int,char_start:int,char_end:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hits of benchmark windows in each document.

    Out, per row of ``docs``: ``id_col``, ``n_words``, ``spans`` (merged runs of hit words: word
    and character offsets, ends exclusive) and ``items`` (sorted ids, as strings, of the items
    with occurring windows). A null or empty text has no words; an item without words has no
    window; a null item id is left out of ``items`` but its windows hit. Repeated rows of either
    table are searched alike. No shuffle: tasks index their own documents, shard by shard. A
    benchmark too large for one pass is searched in further passes that add to the result.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                        F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for group, last in block_groups(benchmark):
        state = state.mapInArrow(_pass(spark.sparkContext.broadcast(group), last),
                                 f"id {kind}, text string, n_words long, spans {_SPANS}, items array<string>")
        if not last:
            state = spool(state, "leaks-pass")
    return state.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def _pass(shared, last: bool):
    def searched(batches):
        for rows in _gathered(batches, 1):
            shard = Shard(texts := rows.column(1).to_pylist())
            for doc, (spans, items) in enumerate(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True)):
                for s in spans:  # of earlier passes
                    shard.hit[shard.starts[doc] + s["start"] : shard.starts[doc] + s["end"]] = True
                if items:
                    shard.items[doc] = set(items)
            for block in shared.value:
                shard.search(pickle.loads(block))
            spans = [[dict(zip(("start", "end", "char_start", "char_end"), s, strict=True)) for s in shard.spans(d)] for d in range(len(texts))]
            items = [sorted(shard.items.get(d, ())) for d in range(len(texts))]
            yield from pa.Table.from_arrays(
                [rows.column(0), pa.nulls(len(texts), pa.string()) if last else rows.column(1), pa.array(shard.counts), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))],
                ["id", "text", "n_words", "spans", "items"]).to_batches()

    return searched


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every hit span cut out of its text, in place; all rows and columns stay.

    Words that a cut brings together are searched again, until no window occurs. A round searches
    all windows on the same text before it cuts: a benchmark of one pass in a task by itself; a
    larger one group by group, with the spans so far beside the text, and again over the rows
    that were cut. Texts without a hit, null texts and other columns (but ``n_chars``, where
    there is one: the new length) are unchanged.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`").cast("string")
    cut, spans = free_name(docs.columns, "__cut"), free_name(docs.columns, "__spans")

    def replaced(rows: DataFrame, new) -> DataFrame:
        """``rows`` with the new text (and number of characters, where the text differs)."""
        rows = rows.withColumn(cut, new)
        columns = {c: F.col(f"`{c}`") for c in docs.columns}
        if "n_chars" in columns:
            columns["n_chars"] = F.when(text.eqNullSafe(F.col(cut)), F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
        columns[text_col] = F.col(cut)
        return rows.select([v.alias(c) for c, v in columns.items()])

    group, only = next(block_groups(benchmark))
    if only:
        return replaced(docs, _cut(spark.sparkContext.broadcast(group))(text))
    done, todo = None, replaced(docs, text)
    while True:
        rows = todo.withColumn(spans, F.array().cast(_SPANS))
        for group, _ in block_groups(benchmark):
            rows = spool(rows.withColumn(spans, _marks(spark.sparkContext.broadcast(group))(text, F.col(spans))), "leaks-marks")
        clean, hit = rows.where(F.size(spans) == 0).drop(spans), rows.where(F.size(spans) > 0)
        done = clean if done is None else done.union(clean)
        if hit.isEmpty():
            return done
        todo = spool(replaced(hit, _without()(text, F.col(spans))), "leaks-cut")


def _kept(text: str, spans: list[tuple[int, int]]) -> str:
    """The text outside of spans of characters."""
    ends = [0, *(b for _, b in spans)]
    return "".join(text[e:s] for e, s in zip(ends, [*(a for a, _ in spans), len(text)], strict=True))


def _without():
    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_kept(t, [(s["char_start"], s["char_end"]) for s in own]) for t, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return without


def _marks(shared):
    @F.arrow_udf(_SPANS)
    def marks(texts: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for group in _shards(before.to_pylist(), texts.to_pylist()):
            shard = Shard([t for _, t in group])
            for doc, (spans, _) in enumerate(group):  # of earlier groups
                for s in spans:
                    shard.hit[shard.starts[doc] + s["start"] : shard.starts[doc] + s["end"]] = True
            for block in shared.value:
                shard.search(pickle.loads(block))
            out += [[dict(zip(("start", "end", "char_start", "char_end"), s, strict=True)) for s in shard.spans(d)] for d in range(len(group))]
        return pa.array(out, pa.list_(_SPAN))

    return marks


def _cut(shared):
    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        todo = [(i, t) for i, t in enumerate(out) if t]
        while todo:
            changed = []
            for group in _shards(*zip(*todo, strict=True)):
                shard = Shard([t for _, t in group])
                for block in shared.value:
                    shard.search(pickle.loads(block))
                for k, (i, t) in enumerate(group):
                    if spans := shard.spans(k):
                        out[i] = _kept(t, [s[2:] for s in spans])
                        changed.append((i, out[i]))
            todo = changed
        return pa.array(out, pa.string())

    return cut
