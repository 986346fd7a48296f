"""Elias-Fano lists of monotone integers, in numpy.

A list of ``n`` integers below ``u`` keeps the low ``l = log2(u / n)`` bits of
each packed side by side, and its high parts as a unary bit string.  A view
reads the packed bytes where they lie (a memory-mapped file, an Arrow buffer);
nothing is unpacked but the places of the string's zeros, which begin the
buckets of equal high parts.
"""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QQQQ")  # n, l, number of buckets, bytes of the low part


def encode(values: np.ndarray, universe: int) -> bytes:
    """Bytes of a sorted list of integers below ``universe`` (at most 2^64)."""
    n = len(values)
    values = values.astype(np.uint64)
    low = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
    if n and low:
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little", count=low)
        packed = np.packbits(bits, bitorder="little").tobytes()
    else:
        packed = b""
    high = (values >> np.uint64(low)).astype(np.int64)
    buckets = ((universe - 1) >> low) + 1
    if n and buckets > 8 * n + 64:  # a universe much larger than the values: stop at the last bucket in use
        buckets = int(high[-1]) + 1
    flags = np.zeros(n + buckets, np.uint8)
    flags[high + np.arange(n)] = 1
    packed += b"\0" * 8  # so that eight bytes can be read at any place
    return HEADER.pack(n, low, buckets, len(packed)) + packed + np.packbits(flags, bitorder="little").tobytes()


class View:
    def __init__(self, raw: bytes, at: int = 0):
        self.n, self.low, self.buckets, size = HEADER.unpack_from(raw, at)
        at += HEADER.size
        self.bytes = np.frombuffer(raw, np.uint8, size, at)
        n_bits = self.n + self.buckets
        flags = np.unpackbits(np.frombuffer(raw, np.uint8, (n_bits + 7) // 8, at + size), bitorder="little", count=n_bits)
        zeros = np.flatnonzero(flags == 0)
        #: first index of each bucket, and the end
        self.first = np.append(0, zeros - np.arange(self.buckets)).astype(np.int64)
        self.size = HEADER.size + size + (n_bits + 7) // 8
        self.mask = np.uint64((1 << self.low) - 1)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(i), np.uint64)
        for j in range(8):
            word |= self.bytes[byte + j].astype(np.uint64) << np.uint64(8 * j)
        return (word >> shift) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at indices."""
        bucket = np.searchsorted(self.first, i, side="right") - 1
        return (bucket.astype(np.uint64) << np.uint64(self.low)) | self.low_bits(i)

    def all(self) -> np.ndarray:
        high = np.repeat(np.arange(self.buckets, dtype=np.uint64), np.diff(self.first))
        return (high << np.uint64(self.low)) | self.low_bits(np.arange(self.n, dtype=np.int64))

    def successor(self, values: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element not below each value, within [lo, hi)
        (default: the whole list); ``hi`` where there is none."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        beyond = high >= self.buckets
        high = np.minimum(high, self.buckets - 1)
        a, b = self.first[high], self.first[high + 1]
        a = np.where(beyond, self.n, a)
        b = np.where(beyond, self.n, b)
        if lo is not None:
            a, b = np.minimum(np.maximum(a, lo), hi), np.minimum(np.maximum(b, lo), hi)
        want = values & self.mask
        while True:  # binary search inside the buckets, all values at once
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            less = self.low_bits(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
