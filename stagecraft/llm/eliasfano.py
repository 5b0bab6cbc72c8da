"""Elias-Fano sequences in plain byte buffers, read by whole arrays of positions at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
# Position of the k-th set bit of a byte (little-endian bit order).
SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        SELECT[_b, _k] = _i


class EliasFano:
    """A non-decreasing sequence of n integers below a universe u, in about 2 + log2(u / n) bits each.

    The low bits lie packed one after another; the high parts are a bit vector in unary, with the number of
    ones before each 64-bit word as its directory.
    """

    def __init__(self, parts: Iterator[np.ndarray]) -> None:
        head = next(parts).view("<i8")
        self.n, self.low_bits = int(head[0]), int(head[1])
        lows, self.high, ones = next(parts), next(parts), next(parts).view("<u4")
        # Eight bytes from any byte offset on.
        self.lows = np.lib.stride_tricks.as_strided(lows[:8].view("<u8"), (len(lows) - 7,), (1,))
        self.ones = ones
        self.words = self.high.reshape(-1, 8)
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, count=bits, bitorder="little")
        lows = np.concatenate([np.packbits(low.ravel(), bitorder="little"), np.zeros(16, np.uint8)])
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-(n + (universe >> bits) + 2) // 64) * 64
        unary = np.zeros(size, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(unary.reshape(-1, 64).sum(1, dtype=np.int64))[:-1]]).astype("<u4")
        return [np.array([n, bits], "<i8").view(np.uint8), lows, high, ones.view(np.uint8)]

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: int) -> np.ndarray:
        word = np.searchsorted(directory, k, "right") - 1
        left = k - directory[word].astype(np.int64)
        octets = self.words[word] ^ np.uint8(flip)
        upto = np.cumsum(POPCOUNT[octets], axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(1)
        left -= np.where(byte > 0, upto[np.arange(len(k)), np.maximum(byte, 1) - 1], 0)
        return word * 64 + byte * 8 + SELECT[octets[np.arange(len(k)), byte], left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        return ((self.lows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (self._select(i, self.ones, 0) - i << self.low_bits) | self._low(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a lesser high part."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        out[some] = self._select(high[some] - 1, self.zeros, 255) - (high[some] - 1)
        return out

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Position of each x inside its range [lo, hi), or -1: a successor search among equal high parts."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.full(len(x), -1)
        high, want = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        a, b = np.maximum(self._below(high), lo), np.minimum(self._below(high + 1), hi)
        end = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        out = np.full(len(x), -1)
        there = np.flatnonzero(a < end)
        out[there] = np.where(self._low(a[there]) == want[there], a[there], -1)
        return out
