"""Counting quotient filters without loss: exact counters of whole keys in little space.

A key of ``bits`` bits is permuted by an invertible mix of that many bits. The first
``quotient_bits`` of the result are the quotient, the others the remainder, stored in full:
the key can be had back, so counts are exact and nothing collides. The remainders of one
quotient form a sorted run with one counter each; runs of many filters with
the same layout are merged by their quotient alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
COUNTER = np.dtype("<u4")


@dataclass(frozen=True)
class Layout:
    """How keys of ``bits`` bits are divided; equal for all filters that are merged."""

    bits: int
    quotient_bits: int

    def __post_init__(self):
        if not 0 < self.quotient_bits < self.bits <= 64:
            raise ValueError(f"keys of {self.bits} bits cannot be divided into quotients of {self.quotient_bits} bits and remainders, or exceed 64 bits")

    @property
    def width(self) -> int:
        """Bytes of a stored remainder."""
        return -(-(self.bits - self.quotient_bits) // 8)

    def _shift(self, x: np.ndarray) -> np.ndarray:
        return x ^ (x >> np.uint64(-(-self.bits // 2)))  # undoes itself

    def permuted(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        for odd in _ODD:
            keys = self._shift(keys) * np.uint64(odd) & mask
        return self._shift(keys)

    def restored(self, x: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        for odd in reversed(_ODD):
            x = self._shift(x) * np.uint64(pow(odd, -1, 1 << 64)) & mask
        return self._shift(x)

    def divided(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quotients and remainders of permuted keys."""
        rest = np.uint64(self.bits - self.quotient_bits)
        return x >> rest, x & np.uint64((1 << int(rest)) - 1)

    def whole(self, quotient: int, remainders: np.ndarray) -> np.ndarray:
        """The keys of one run."""
        return self.restored(np.uint64(quotient << (self.bits - self.quotient_bits)) | remainders)

    def pack(self, remainders: np.ndarray) -> np.ndarray:
        """Remainders as bytes, ``width`` each."""
        return np.ascontiguousarray(remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]).ravel()

    def unpack(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros((len(data) // self.width, 8), np.uint8)
        out[:, : self.width] = data.reshape(-1, self.width)
        return out.view("<u8").ravel()


def build(keys: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Count keys: (quotients that occur, end of each one's run, all remainders, all counters)."""
    x, counts = np.unique(layout.permuted(keys.astype(np.uint64)), return_counts=True)
    quotient, rest = layout.divided(x)
    ends = np.append(np.flatnonzero(quotient[1:] != quotient[:-1]) + 1, len(quotient)) if len(quotient) else np.zeros(0, np.int64)
    return quotient[ends - 1], ends, rest, counts


def merge(remainders: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of one quotient from many filters, one after another, as one run."""
    order = np.argsort(remainders, kind="stable")  # sorted stretches are merged, not sorted anew
    r, c = remainders[order], counters[order].astype(np.int64)
    if not len(r):
        return r, c
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    return r[first], np.add.reduceat(c, first)
