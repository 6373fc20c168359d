"""A compressed FM-index over integer symbols, in numpy.

The Burrows-Wheeler transform is held in a wavelet tree, level by level: one
packed bit vector for each bit of the symbols, with counts of ones in two
layers (a quarter bit for each bit).  Of the suffix array only every few
positions are kept; a row is located by stepping back to the next of them.
"""

from __future__ import annotations

import numpy as np

#: One text position in so many is kept with its row.
RATE = 4

_ONE = np.uint64(1)


class Bits:
    """A bit vector with constant-time rank: 64-bit words, ones before each word inside its block of 64 words, ones before each block."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.blocks = before[::64].copy()
        self.inside = (before - np.repeat(self.blocks, 64)[: len(before)]).astype(np.uint16)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.blocks[at >> 6] + self.inside[at] + np.bitwise_count(self.words[at] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & _ONE).astype(np.int64)

    def nbytes(self) -> int:
        return self.words.nbytes + self.inside.nbytes + self.blocks.nbytes


class WaveletTree:
    """Ranks of any symbol in a sequence, from one bit vector for each level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        self.height = max(1, int(symbols - 1).bit_length())
        now = sequence
        for level in range(self.height - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bits, level in zip(self.levels, range(self.height - 1, -1, -1)):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its position i."""
        return self._down(symbol, i) - self.base[symbol]

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before its positions ``low`` and ``high``."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(symbol)], both[len(symbol) :]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the symbol at each position, its occurrences before that)."""
        symbol = np.zeros(len(i), np.int64)
        for bits in self.levels:
            bit, ones = bits.get(i), bits.rank(i)
            i = np.where(bit, bits.zeros + ones, i - ones)
            symbol = symbol * 2 + bit
        return symbol, i - self.base[symbol]


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    step = np.concatenate([[0], (np.diff(keys[order]) != 0).astype(np.int64)])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out


def _suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling until every suffix has a rank of its own."""
    n = len(text)
    rank, size = _dense(text), 1
    while size < n and rank.max() < n - 1:
        rank = _dense(rank * (n + 2) + np.concatenate([rank[size:] + 1, np.zeros(size, np.int64)]))
        size *= 2
    return np.argsort(rank, kind="stable")


class FmIndex:
    """Backward search in a text of symbols below ``symbols``; symbol 0 ends every piece of it and is in no pattern."""

    def __init__(self, text: np.ndarray, symbols: int):
        if not len(text) or text[-1]:
            raise ValueError("the text must end in symbol 0")
        text = text.astype(np.int64)
        suffixes = _suffixes(text)
        before = text[suffixes - 1]
        self.n = len(text)
        self.tree = WaveletTree(before, symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        kept = (suffixes % RATE == 0) | (before == 0)  # a step back never crosses a separator
        self.kept = Bits(kept.astype(np.uint8))
        self.positions = suffixes[kept].astype(np.uint32 if self.n < 1 << 32 else np.int64)

    def nbytes(self) -> int:
        return sum(b.nbytes() for b in (*self.tree.levels, self.kept)) + self.positions.nbytes + self.smaller.nbytes + self.tree.base.nbytes

    def statistics(self, query: np.ndarray, ends: np.ndarray, floors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end in ``query`` the length of the longest match of the text that ends there.

        A match begins at or after its floor and has ``most`` symbols at most;
        symbol 0 matches nothing.  (length, first row, row after the last) of
        the suffixes that begin with the match.  All ends are searched in step,
        symbol by symbol from the right; an end that fails is done.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.arange(len(ends))
        for t in range(most):
            at = ends[live] - 1 - t
            live, at = live[at >= floors[live]], at[at >= floors[live]]
            symbol = query[at]
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            if not len(live):
                break
            a, b = self.smaller[symbol], self.smaller[symbol + 1]
            if t:
                a, b = a.copy(), a.copy()
                alone = high[live] - low[live] == 1  # one row left: what stands before it is read once
                own, count = self.tree.access(low[live[alone]])
                a[alone] += count
                b[alone] += count + (own == symbol[alone])
                wide = ~alone
                below, upto = self.tree.ranks(symbol[wide], low[live[wide]], high[live[wide]])
                a[wide] += below
                b[wide] += upto
            there = a < b
            live, a, b = live[there], a[there], b[there]
            low[live], high[live], length[live] = a, b, t + 1
        return length, low, high

    def occurrences(self, query: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
        """For each stretch of ``size`` symbols from ``at`` a row of a suffix that begins with it, -1 if the text lacks it.

        ``at[first[i] : first[i] + count[i]]`` are consecutive positions.  They
        are gone through from the last one, all stretches in step: where the
        symbol before the row found is the next one of the query, one step back
        is the match of the next position, else that is searched anew.
        """
        out = np.full(len(at), -1, np.int64)
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        row, live = np.full(len(first), -1, np.int64), len(first)
        for t in range(int(count[0]) if len(count) else 0):
            while count[live - 1] <= t:
                live -= 1
            w = first[:live] + count[:live] - 1 - t
            now = np.full(live, -1, np.int64)
            known = np.flatnonzero(row[:live] >= 0)
            symbol, before = self.tree.access(row[known])
            same = (symbol == query[at[w[known]]]) & (symbol > 0)
            now[known[same]] = self.smaller[symbol[same]] + before[same]
            anew = np.flatnonzero(now < 0)
            length, low, _ = self.statistics(query, at[w[anew]] + size, at[w[anew]], size)
            now[anew[length == size]] = low[length == size]
            row[:live] = out[w] = now
        return out

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        out = np.empty(len(rows), np.int64)
        live, row, steps = np.arange(len(rows)), rows, 0
        while len(live):
            known = self.kept.get(row) == 1
            out[live[known]] = self.positions[self.kept.rank(row[known])] + steps
            live, row = live[~known], row[~known]
            symbol, count = self.tree.access(row)
            row, steps = self.smaller[symbol] + count, steps + 1
        return out

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position in each (not empty) range of rows."""
        size = high - low
        flat = np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.minimum.reduceat(self.locate(flat), np.cumsum(size) - size) if len(size) else np.zeros(0, np.int64)
