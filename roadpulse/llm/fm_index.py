"""FM-index over words: suffix order, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every how many-th position of the text is kept with the suffix order.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. Symbol 0 ends a run of words; each one differs from all others.

    Prefix doubling: ranks of ``k`` symbols give those of ``2 * k``; only positions whose rank is shared are sorted again.
    """
    size = len(symbols)
    ends = symbols == 0
    key = symbols.astype(np.int64) + int(ends.sum())
    key[ends] = np.arange(ends.sum())
    order = np.argsort(key, kind="stable")
    rank = np.empty(size + 1, np.int64)
    rank[size] = -1
    step = 1
    ordered = key[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(size), 0))
    while True:
        sizes_shared = ~(heads & np.append(heads[1:], True))
        shared = np.flatnonzero(sizes_shared)
        if not len(shared):
            return order
        at = order[shared]
        pairs = np.lexsort((rank[np.minimum(at + step, size)], rank[at]))
        at = at[pairs]
        order[shared] = at
        first, second = rank[at], rank[np.minimum(at + step, size)]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        heads[shared] = new
        rank_at = np.maximum.accumulate(np.where(new, shared, 0))
        rank[at] = rank_at
        step *= 2


class WaveletTree:
    """Bits of the symbols, highest first, stably parted level by level, with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.size - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a level."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at`` symbols."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            low, high = self._ones(level, start), self._ones(level, end)
            start = np.where(one, self.zeros[level] + low, start - low)
            end = np.where(one, self.zeros[level] + high, end - high)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols at these places."""
        symbols, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            symbols = symbols << 1 | one
        return symbols


class FmIndex:
    """Index of a sequence of symbols in ``[0, alphabet)`` where 0 ends a run; the last symbol must be 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        last = symbols[order - 1]  # position 0 is preceded by the final 0
        self.size = len(symbols)
        self.tree = WaveletTree(last.astype(np.int64), max(1, int(alphabet - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))]).astype(np.int64)
        kept = order % SAMPLE == 0
        # A run's end has no usable predecessor link, as ends differ among themselves; so positions after one are kept too.
        kept |= symbols[order - 1] == 0
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern; rows are padded on the right, no pattern holds 0."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(patterns.shape[1]):
            live = np.flatnonzero((back < lengths) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - back]
            base = self.before[symbol]
            low[live] = base + self.tree.rank(symbol, low[live])
            high[live] = base + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order: steps back until a kept position."""
        found, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            kept = self.kept[at]
            found[open_[kept]] = self.positions[self.kept_rank[at[kept]]] + steps[open_[kept]]
            open_, at = open_[~kept], at[~kept]
            symbol = self.tree.access(at)
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps[open_] += 1
        return found
