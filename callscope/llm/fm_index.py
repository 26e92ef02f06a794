"""Word-level FM-index of one shard of documents: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray, n_separators: int) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling over the suffixes still tied.

    ``symbols`` gives each separator its own number below ``n_separators`` (so comparisons end
    there); words are numbered from ``n_separators``. The last symbol must be a separator.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.empty(n, bool)
    first[:1], first[1:] = True, ordered[1:] != ordered[:-1]
    slot = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot
    alone = first & np.append(first[1:], True)
    tied, depth = np.flatnonzero(~alone), 1  # slots of the order whose suffixes still tie
    while len(tied):
        at = order[tied]
        own = rank[at]
        key = own * n + rank[at + depth]  # a tied suffix has no separator yet, so it goes on
        by = np.argsort(key, kind="stable")
        at, own, key = at[by], own[by], key[by]
        order[tied] = at
        first = np.empty(len(at), bool)
        first[:1], first[1:] = True, key[1:] != key[:-1]
        slot = np.maximum.accumulate(np.where(first, tied, 0))
        rank[at] = slot
        tied = tied[~(first & np.append(first[1:], True))]
        depth *= 2
    return order


class Bits:
    """A bit vector with ranks: packed words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def __getitem__(self, i):
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i):
        """Ones before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """Wavelet matrix: ranks and access over numbers below ``size``."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels, self.zeros, self.shifts = [], [], list(range(max(1, (size - 1).bit_length())))[::-1]
        for shift in self.shifts:
            bit = (values >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            values = np.concatenate([values[~bit], values[bit]])
            self.zeros.append(len(bit) - int(self.levels[-1].before[-1]))
        # where each number's run starts on the last level
        self.starts = np.searchsorted(_reversed(values, len(self.shifts)), _reversed(np.arange(size), len(self.shifts)))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times each symbol stands before each position."""
        for bits, zeros, shift in zip(self.levels, self.zeros, self.shifts, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i - self.starts[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros, shift in zip(self.levels, self.zeros, self.shifts, strict=True):
            bit, ones = bits[i], bits.rank(i)
            symbol |= bit.astype(np.int64) << shift
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i - self.starts[symbol]


def _reversed(values: np.ndarray, n_bits: int) -> np.ndarray:
    """Numbers with their bits reversed: the order of the wavelet matrix's last level."""
    out = np.zeros_like(values)
    for b in range(n_bits):
        out |= ((values >> b) & 1) << (n_bits - 1 - b)
    return out


class FmIndex:
    """Backward search and location over a sequence of words (1..size-1) and separators (0).

    Separators sort by place, so each differs from all others; patterns hold none. Every
    ``SAMPLE``-th position and every position after a separator is kept, so a walk back from
    a match never crosses a separator.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        gaps = symbols == 0
        n_gaps = int(gaps.sum())
        order = suffix_order(np.where(gaps, np.cumsum(gaps) - 1, symbols + (n_gaps - 1)).astype(np.int64), n_gaps)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.n = len(symbols)
        self.last = Wavelet(before.astype(np.int64), size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))]).astype(np.int64)
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots [low, high) of the suffixes that begin with each pattern (rows, left-aligned)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(patterns.shape[1] if len(patterns) else 0):
            on = np.flatnonzero((back < lengths) & (low < high))
            if not len(on):
                break
            c = patterns[on, lengths[on] - 1 - back].astype(np.int64)
            low[on] = self.first[c] + self.last.rank(c, low[on])
            high[on] = self.first[c] + self.last.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a kept one."""
        out, steps = np.empty(len(slots), np.int64), np.zeros(len(slots), np.int64)
        on = np.arange(len(slots))
        while len(on):
            known = self.kept[slots[on]]
            done = on[known]
            out[done] = self.places[self.kept.rank(slots[done])] + steps[done]
            on = on[~known]
            if len(on):
                symbol, rank = self.last.access(slots[on])
                slots = slots.copy()
                slots[on] = self.first[symbol] + rank
                steps[on] += 1
        return out
