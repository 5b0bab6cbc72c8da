"""An FM-index over word numbers: the Burrows-Wheeler transform in a wavelet matrix with rank directories."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols by bits, the highest first; each level puts the zeros before the ones."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k & 1).astype(np.uint8)
            self.levels.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of a symbol before lo and before hi end in the sorted last level."""
        for k, level, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            one = (symbol >> k & 1).astype(bool)
            a, b = level.rank(lo), level.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return lo, hi


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by doubling."""
    n, rank, step = len(text), text.astype(np.int64), 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-step or n] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 3) + following
        order = np.argsort(key, kind="stable")
        found = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], found[1:] != found[:-1]]))
        rank, step = new, step * 2
        if step >= depth or step >= n or rank.max(initial=0) == n - 1:
            return order


class FMIndex:
    """Counts a pattern of up to ``depth`` symbols by backward search.  Symbol 0 ends each text."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        order = suffix_order(text, depth)
        before = text[order - 1]  # the symbol before the first is the last, an end
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.tree = WaveletMatrix(before, bits)
        # Where each symbol's run begins in the matrix's last level.
        symbols = np.arange(1 << bits)
        self.base = self.tree.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))[0]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol and go on with a suffix of [lo, hi)."""
        a, b = self.tree.rank(symbol, lo, hi)
        shift = self.first[symbol] - self.base[symbol]
        return a + shift, b + shift

    def repeated(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Whether the match at each start (matching statistic with one other place) reaches ``length``.

        Searches backward from the last symbol of each; a search ends when only one suffix is left.
        """
        out = np.zeros(len(starts), bool)
        live = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for k in range(length - 1, -1, -1):
            lo, hi = self.extend(text[starts[live] + k], lo, hi)
            more = hi - lo > 1
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                return out
        out[live] = True
        return out
