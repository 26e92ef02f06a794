"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file set is a Parquet folder of *segments*, written by Spark's own committer (a lost
task leaves nothing behind) in ascending document order. A segment row holds

* ``ids``: the ids of its documents end to end, little-endian unsigned 32-bit;
* ``bounds``: Elias-Fano code of the position after each document's last id;
* ``doc_ids``: Elias-Fano code of the ascending document ids less ``doc_base``, the last
  being ``last_id`` (the first ``n_null`` documents have a null id);
* ``part``, ``seq``: its place in the order, ``start``: its first position in its part, and
  ``n_docs``, ``n_ids``.

The small ``parts`` folder beside it has each part's first position in the whole.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import partitions, prepare
from callscope.llm.pieces import split

#: Ids a segment has before it is closed (a longer document still stays whole).
SEGMENT_IDS = 1_000_000
#: Texts' characters that are encoded at once, and new pieces that a worker remembers before it forgets those before them.
CHUNK_CHARS, MEMO_PIECES = 6_000_000, 350_000
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of n unsigned numbers in about n * (2 + log2(max / n)) bits.

    The low ``l`` bits of each number are packed; the high parts are unary in one bit
    vector, where number i's bit stands at ``high(i) + i``. The word and the rank of every
    64th such bit are kept, so ``select`` reads a few words to find any number.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, hints: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.hints = n, low_bits, low, high, hints

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(place[-1]) // 64 + 1 if n else 0, np.uint64)
        np.bitwise_or.at(high, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        return cls(n, bits, low, high, place[::SAMPLE].astype(np.uint32) if not n or place[-1] < 2**32 else place[::SAMPLE])

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBBQQ", self.n, self.low_bits, self.hints.itemsize, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.hints.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, size, n_low, n_high = struct.unpack_from("<QBBQQ", data)
        at = struct.calcsize("<QBBQQ")
        low = np.frombuffer(data, "<u8", n_low, at)
        high = np.frombuffer(data, "<u8", n_high, at + 8 * n_low)
        hints = np.frombuffer(data, "<u4" if size == 4 else "<u8", -1, at + 8 * (n_low + n_high)) if n else np.zeros(0, "<u4")
        return cls(n, bits, low, high, hints)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # the shift is split in two, as a shift by 64 is not defined
        value = (self.low[word] >> shift) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return value & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Number i, through the nearest hint before it."""
        place, left = int(self.hints[i // SAMPLE]), i % SAMPLE
        word = place >> 6
        bits = int(self.high[word]) >> (place & 63) << (place & 63)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Numbers a to b - 1, from the words between the hints around them."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first, last = a // SAMPLE, -(-b // SAMPLE)
        begin = int(self.hints[first])
        word = begin >> 6
        until = (int(self.hints[last]) >> 6) + 1 if last < len(self.hints) else len(self.high)
        bits = np.unpackbits(self.high[word:until].view(np.uint8), bitorder="little")
        bits[: begin & 63] = 0
        skip = a - first * SAMPLE
        places = np.flatnonzero(bits)[skip : skip + b - a].astype(np.uint64) + np.uint64(word * 64)
        i = np.arange(a, b, dtype=np.uint64)
        return ((places - i) << np.uint64(self.low_bits)) | self._low(i)

    def first_not_below(self, value: int) -> int:
        """The number of values below ``value``, by binary search with ``select``."""
        a, b = 0, self.n
        while a < b:
            middle = (a + b) // 2
            a, b = (middle + 1, b) if self.select(middle) < value else (a, middle)
        return a


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)).difference(shown)))}


class Encoder:
    """A byte-level BPE vocabulary of the ``tokenizers`` library that remembers the ids of pieces.

    The file's added tokens are cut out of a text first (special ones only if
    ``encode_special_tokens`` is not set, as in the library). The library's model encodes each
    new piece of the rest (the pattern's matches are what its pre-tokenizer would hand to the
    model, in its letters for bytes). A text that holds an added token which takes white space
    or whole words goes to the library as it is.
    """

    _open: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, encode_special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = encode_special_tokens
        self.model = tokenizer.model
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items() if t.content}
        self.added = {content: array("I", [i]).tobytes() for content, (i, t) in added.items() if not (t.special and encode_special_tokens)}
        longest = sorted(added, key=len, reverse=True) if self.added else []  # those spelt out take part in matching
        greedy = [c for c in longest if added[c][1].single_word or added[c][1].lstrip or added[c][1].rstrip]
        self.tokenizer = tokenizer if greedy else None
        self.cuts, self.whole = (re.compile("|".join(map(re.escape, x))) if x else None for x in (longest, greedy))
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, encode_special_tokens: bool = True) -> Encoder:
        """This worker's encoder for the file."""
        key = path, encode_special_tokens
        if key not in cls._open:
            cls._open[key] = cls(*key)
        return cls._open[key]

    def _pieces(self, text: str) -> list[str]:
        """A text's pieces, added tokens among them."""
        if not any(content in text for content in self.added):
            return split(text)
        out, at = [], 0
        for m in self.cuts.finditer(text):
            if m[0] in self.added:
                out += [*split(text[at : m.start()]), m[0]]
                at = m.end()
        return out + split(text[at:]) if at else split(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        The texts' pieces are numbered, so that each distinct one is looked up once, and the
        ids are then gathered by number.
        """
        if self.whole is not None and (own := {k for k, t in enumerate(texts) if self.whole.search(t)}):
            rest = iter(self.ids([t for k, t in enumerate(texts) if k not in own]) if len(own) < len(texts) else ())
            return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if k in own else next(rest) for k, t in enumerate(texts)]
        pieces = [self._pieces(t) for t in texts]
        numbered = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
        counts = [len(p) for p in pieces]
        del pieces
        rows = self._looked_up(numbered.dictionary.to_pylist())
        table, sizes = np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int32, len(rows)) >> 2
        number = numbered.indices.to_numpy()
        n = sizes[number]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        kind = np.int32 if ends[-1] < 2**31 and len(table) < 2**31 else np.int64
        # each piece's place in the table, moved by its place in the result
        shift = ((np.cumsum(sizes, dtype=np.int64) - sizes)[number] - ends[:-1]).astype(kind)
        ids = table[np.repeat(shift, n) + np.arange(ends[-1], dtype=kind)]
        cuts = ends[np.cumsum([0, *counts])]
        return [ids[a:b].tobytes() for a, b in pairwise(cuts.tolist())]

    def _looked_up(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct pieces: remembered, or encoded now. Pieces not met for long are forgotten."""
        if len(self.memo) > MEMO_PIECES:
            self.before, self.memo = self.memo, {}
        memo, before = self.memo, self.before
        rows = list(map(memo.get, distinct))
        new = []
        for at, piece in [(at, piece) for at, (piece, ids) in enumerate(zip(distinct, rows, strict=True)) if ids is None]:
            if (ids := before.get(piece)) is None:
                new.append(at)
            else:
                rows[at] = memo[piece] = ids
        encode, letters = self.model.tokenize, self.letters
        for at in new:
            piece = distinct[at]
            if (ids := self.added.get(piece)) is not None:
                rows[at] = memo[piece] = ids
                continue
            tokens = encode(piece.encode().decode("latin-1").translate(letters))
            rows[at] = memo[piece] = array("I", [t.id for t in tokens]).tobytes()
        return rows


SEGMENT = ("part int, seq int, start long, n_docs int, n_ids long, n_null int, doc_base long, last_id long, ids binary, bounds binary, "
           "doc_ids binary")
_DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def _segments(path: str, end: bytes, encode_special_tokens: bool = True):
    def segments(batches):
        encoder, part = Encoder.of(path, encode_special_tokens), TaskContext.get().partitionId()
        docs, ids, held, seq, start = [], [], 0, 0, 0

        def segment():
            known = [d for d in docs if d is not None]
            base = known[0] if known else 0
            ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
            row = {"part": part, "seq": seq, "start": start, "n_docs": len(docs), "n_ids": int(ends[-1]), "n_null": len(docs) - len(known), "doc_base": base, "last_id": known[-1] if known else None, "ids": b"".join(ids),
                   "bounds": EliasFano.encode(ends).to_bytes(), "doc_ids": EliasFano.encode([d - base for d in known]).to_bytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("n_null", pa.int32()), ("doc_base", pa.int64()), ("last_id", pa.int64()), ("ids", pa.binary()), ("bounds", pa.binary()), ("doc_ids", pa.binary())]))

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= CHUNK_CHARS):
                    chars += len(texts[to])
                    to += 1
                for name, own in zip(names[at:to], encoder.ids(texts[at:to]), strict=True):
                    docs.append(name)
                    ids.append(own + end)
                    held += len(own) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield segment()
                        docs, ids, held, seq, start = [], [], 0, seq + 1, start + held
                at = to
        if docs:
            yield segment()

    return segments


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int = 0, encode_special_tokens: bool = True) -> None:
    """Encode each whole text (null: empty), append ``end_id`` and write all ids in ascending id order.

    The file's special tokens are spelt out where a text holds them; with ``encode_special_tokens``
    off (the library's default) they get their own ids.

    Null ids come first; rows of one id are ordered by their text's hash and text. The
    documents are range-partitioned on (id, hash), so rows that repeat an id are spread too.
    An empty table gives an empty file set. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_segments(tokenizer, int(end_id).to_bytes(4, "little"), encode_special_tokens), SEGMENT).write.parquet(f"{path}/segments")
    # each part's place in the whole: a row a part
    sizes = spark.read.schema(SEGMENT).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base")).write.parquet(f"{path}/parts")


def _read(row: dict, data: pa.Buffer, a: int, b: int) -> pa.RecordBatch:
    """Documents a to b - 1 of a segment: what bounds and ids say is selected, nothing else decoded."""
    bounds, known = EliasFano.from_bytes(row["bounds"]), EliasFano.from_bytes(row["doc_ids"])
    ends = bounds.select_range(max(0, a - 1), b).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if not a else ends[:-1]
    ends = ends if not a else ends[1:]
    offsets = pa.array((np.concatenate([starts, ends[-1:]]) - starts[0]) * 4, pa.int32())
    body = data.slice(int(starts[0]) * 4, int(ends[-1] - starts[0]) * 4)
    nulls = row["n_null"]
    ids = known.select_range(max(0, a - nulls), max(0, b - nulls)).astype(np.int64) + row["doc_base"]
    names = [None] * max(0, min(b, nulls) - a) + ids.tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(ends - starts, pa.int64()),
         pa.Array.from_buffers(pa.binary(), b - a, [None, offsets.buffers()[1], body])], ["doc_id", "start", "n_tokens", "ids"])


def _rows(batches):
    for batch in batches:
        ids = batch.column("ids")
        for at, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
            yield row, ids[at].as_buffer()


def _documents(batches):
    for row, data in _rows(batches):
        bounds, a = EliasFano.from_bytes(row["bounds"]), 0
        while a < bounds.n:  # some thousand documents or a gigabyte of ids at a time (or one document)
            before = bounds.select(a - 1) if a else 0
            ends = bounds.select_range(a, min(bounds.n, a + 2048))
            b = a + max(1, int(np.searchsorted(ends, before + (1 << 28), "right")))
            yield _read(row, data, a, b)
            a = b


def _some(wanted: list[int]):
    def some(batches):
        for row, data in _rows(batches):
            known = EliasFano.from_bytes(row["doc_ids"])
            for one in wanted:
                at = known.first_not_below(one - row["doc_base"]) if one >= row["doc_base"] else known.n
                while at < known.n and known.select(at) + row["doc_base"] == one:  # rows may share an id
                    yield _read(row, data, at + row["n_null"], at + row["n_null"] + 1)
                    at += 1

    return some


def _segments_of(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    # two numbers a part, and no more parts than the write had partitions: small, whatever the segments hold
    parts = F.broadcast(spark.read.schema("part int, base long").parquet(f"{path}/parts"))
    return segments.join(parts, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
    return _segments_of(spark, path).mapInArrow(_documents, _DOCUMENT)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The documents of the given ids (all rows of an id), columns as of :func:`read_token_ids`.

    Segments are in ascending order of ids, so the range of their ids leaves those out that cannot
    hold one; in the others a document is found and cut out by ``select`` alone.
    """
    wanted = sorted({int(i) for i in ids})
    held = F.exists(F.array(*map(F.lit, wanted)), lambda i: (i >= F.col("doc_base")) & (i <= F.col("last_id"))) if wanted else F.lit(False)
    rows = _segments_of(spark, path).where((F.col("n_docs") > F.col("n_null")) & F.col("doc_base").isNotNull())
    rows = rows.where((F.col("doc_base") <= max(wanted, default=0)) & (F.col("last_id") >= min(wanted, default=0)) & held)
    return rows.mapInArrow(_some(wanted), _DOCUMENT)
