"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their boundary.

Two levels share the scheme. A *text* is split into pieces by the vocabulary's pattern:
its halves are split recursively, and neighbours are joined by splitting a growing window
around their boundary anew, until a boundary of the window falls on one of the right
half's that later characters cannot move. A *piece* is merged by rank: its halves are
encoded recursively, and neighbours are joined by encoding a growing window of tokens
anew, until the tokens on both its edges are compatible with the tokens outside. A token
sequence is the encoding of its bytes exactly if every two adjacent tokens are compatible
(encoding their joined bytes gives the two back), so the tokens outside are then final.
Decoding concatenates halves up the same tree.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import prepare
from callscope.llm.pieces import split

#: Leaves of the trees: characters of a text, bytes of a piece, ids of a decoded text.
TEXT_LEAF, PIECE_LEAF, IDS_LEAF = 2048, 24, 4096
#: Pieces and token pairs that a worker remembers, and bytes up to which the merge scans all pairs for the best.
MEMO, SCAN = 400_000, 64


class ByteBpe:
    """A rank table's encoder and decoder."""

    _open: dict[str, ByteBpe] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        """This worker's encoder for a file of base64 tokens and ranks."""
        if path not in cls._open:
            with open(path, "rb") as f:
                cls._open[path] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        return cls._open[path]

    def merge(self, data: bytes) -> list[int]:
        """The definition: of all adjacent parts that join to a token, the lowest-ranked, leftmost first."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > SCAN:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best, at = None, -1
            for i, c in enumerate(costs):
                if c is not None and (best is None or c < best):
                    best, at = c, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of the joinable pairs and a linked list of the parts: n log n."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0: none does
        before = list(range(-1, n - 1))  # start of the part before
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, a, b = heappop(heap)
            middle = end[a]
            if not middle or middle >= n or end[middle] != b:
                continue  # one of the two was joined meanwhile
            end[a], end[middle] = b, 0
            if b < n:
                before[b] = a
                if (rank := ranks.get(data[a : end[b]])) is not None:
                    heappush(heap, (rank, a, end[b]))
            if a and (rank := ranks.get(data[before[a] : b])) is not None:
                heappush(heap, (rank, before[a], b))
        out, a = [], 0
        while a < n:
            out.append(ranks[data[a : end[a]]])
            a = end[a]
        return out

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            if not i or not j:
                return left + right
            window = left[len(left) - i :] + right[:j]
            if i == j == 1:
                new = window if self.compatible(*window) else self.merge(b"".join(map(self.bytes.__getitem__, window)))
            else:
                new = self.merge(b"".join(map(self.bytes.__getitem__, window)))
            ahead = i == len(left) or self.compatible(left[-i - 1], new[0])
            behind = j == len(right) or self.compatible(new[-1], right[j])
            if ahead and behind:
                return left[: len(left) - i] + new + right[j:]
            i, j = (i if ahead else 2 * i), (j if behind else 2 * j)

    def encode_bytes(self, data: bytes, known: dict[bytes, list[int]] | None = None) -> list[int]:
        """The encoding of a piece's bytes: of a left part of a power of two and the rest, joined.

        Parts of equal bytes are encoded once, and the tokens of a run (whose lengths mostly divide a
        power of two) then end at the boundary, so joining runs moves none of them.
        """
        if data in self.ranks:
            return [self.ranks[data]]
        if len(data) <= PIECE_LEAF:
            return self.merge(data)
        known = {} if known is None else known
        if (found := known.get(data)) is None:
            half = 1 << (len(data) - 1).bit_length() - 1
            found = known[data] = self.join_tokens(self.encode_bytes(data[:half], known), self.encode_bytes(data[half:], known))
        return found

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a piece as native 32-bit integers, remembered."""
        known = self.memo.get(piece)
        if known is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = np.array(self.encode_bytes(piece.encode()), np.int32).tobytes()
            if len(piece) <= 64:
                self.memo[piece] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        try:  # all pieces known
            return np.frombuffer(b"".join(map(self.memo.__getitem__, pieces := split_tree(text))), np.int32)
        except KeyError:
            return np.frombuffer(b"".join(map(self.encode_piece, pieces)), np.int32)

    def decode(self, ids) -> bytes:
        """Bytes of ids; halves are decoded and concatenated."""
        if len(ids) <= IDS_LEAF:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def join_pieces(left: list[str], right: list[str]) -> list[str]:
    """The pieces of two joined texts, from the pieces of each.

    A piece's end depends on its own characters and at most two after it, so the left text's
    pieces with two characters behind them stay. A match starts from its position alone, so
    once a settled boundary of the window is one of the right text's, the right's rest stays.
    """
    keep, tail = len(left), 0
    while keep and tail < 2:
        keep -= 1
        tail += len(left[keep])
    begin = "".join(left[keep:])
    taken = 1
    while True:
        taken = min(taken, len(right))
        window = split(begin + "".join(right[:taken]))
        if taken == len(right):
            return left[:keep] + window
        borders, at = {}, len(begin)
        for m, piece in enumerate(right[:taken]):
            borders[at] = m
            at += len(piece)
        place = 0
        for n, piece in enumerate(window):
            place += len(piece)
            if place in borders and place + 2 <= at:
                return left[:keep] + window[: n + 1] + right[borders[place] :]
        taken *= 2


def split_tree(text: str) -> list[str]:
    """The pattern's matches in a text of any length."""
    if len(text) <= TEXT_LEAF:
        return split(text)
    half = len(text) // 2
    return join_pieces(split_tree(text[:half]), split_tree(text[half:]))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row's whole text; null and empty texts have no ids.

    One row out for each row in, repeated ones included; other columns are not read, and an
    empty table gives an empty one. Time grows as n log n with the length of a text, also where it
    is one piece (a rule line of a million dashes).
    """
    prepare(docs.sparkSession)

    def encoded(batches):
        bpe = ByteBpe.of(ranks)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`")).mapInArrow(encoded, f"id {kind}, ids array<int>") \
        .withColumnRenamed("id", id_col)


def decode_ids(ranks: str):
    """A function of a column of ids (array of int; null: none) that gives the decoded bytes."""

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        bpe = ByteBpe.of(ranks)
        return pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in ids], pa.binary())

    return decoded


def digests(ids: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """Of ``encode``'s rows: ``n_tokens``, the SHA-256 of the decimal ids joined by spaces and that of the decoded bytes."""
    return ids.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode_ids(ranks)("ids"), 256).alias("decoded_sha256"))
