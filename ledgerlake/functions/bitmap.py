"""Compressed integer bitmaps: one container per range of 65,536 codes.

A container holds its low 16 bits either as a sorted array (sparse) or as 1,024 words
(dense), whichever is smaller. Only the set operations the reference check needs exist.
"""

from __future__ import annotations

import numpy as np

RANGE_BITS = 16
SPARSE_MAX = 4096
_WORDS = (1 << RANGE_BITS) // 64


def _dense(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << RANGE_BITS, dtype=np.uint8)
    bits[values] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _sparse(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).astype(np.uint16)


def _shrink(words: np.ndarray) -> np.ndarray:
    values = _sparse(words)
    return values if values.size <= SPARSE_MAX else words


def _is_dense(c: np.ndarray) -> bool:
    return c.dtype == np.uint64


class Bitmap:
    """A set of non-negative integers below 2**31."""

    __slots__ = ("ranges",)

    def __init__(self, ranges: dict[int, np.ndarray] | None = None):
        self.ranges = ranges or {}

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(codes)
        out: dict[int, np.ndarray] = {}
        if codes.size:
            high = codes >> RANGE_BITS
            starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], codes.size], strict=True):
                low = (codes[s:e] & ((1 << RANGE_BITS) - 1)).astype(np.uint16)
                out[int(high[s])] = low if low.size <= SPARSE_MAX else _dense(low)
        return cls(out)

    def or_(self, other: Bitmap) -> Bitmap:
        out = dict(self.ranges)
        for k, b in other.ranges.items():
            a = out.get(k)
            if a is None:
                out[k] = b
            elif not _is_dense(a) and not _is_dense(b):
                u = np.union1d(a, b)
                out[k] = u if u.size <= SPARSE_MAX else _dense(u)
            else:
                out[k] = (a if _is_dense(a) else _dense(a)) | (b if _is_dense(b) else _dense(b))
        return Bitmap(out)

    def and_not(self, other: Bitmap) -> Bitmap:
        out: dict[int, np.ndarray] = {}
        for k, a in self.ranges.items():
            b = other.ranges.get(k)
            if b is None:
                out[k] = a
                continue
            if _is_dense(a):
                left = _shrink(a & ~(b if _is_dense(b) else _dense(b)))
            elif _is_dense(b):
                left = a[((b[a >> 6] >> (a & 63).astype(np.uint64)) & np.uint64(1)) == 0]
            else:
                left = np.setdiff1d(a, b, assume_unique=True)
            if left.size:
                out[k] = left
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        parts = [(k << RANGE_BITS) + (_sparse(c) if _is_dense(c) else c).astype(np.int64) for k, c in sorted(self.ranges.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
