"""Elias-Fano sequences in numpy arrays that can be mapped from files."""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np


def saved(path: str, values: np.ndarray) -> None:
    """Write an array under ``path`` in one step, so that attempts of one task on several machines do not mix."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, path)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, back to back in 64-bit words: 64 values fill ``width`` words."""
    n = -(-len(values) // 64)
    rows = np.zeros(n * 64, np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(n, 64)
    out = np.zeros((n, width), np.uint64)
    for j in range(64 if width else 0):
        word, off = divmod(j * width, 64)
        out[:, word] |= rows[:, j] << np.uint64(off)
        if off + width > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - off)
    return np.append(out.ravel(), np.uint64(0))  # a word more, so that a read may look one ahead


class EliasFano:
    """A non-decreasing sequence of numbers below ``universe``.

    The low ``width`` bits of each number are stored back to back, the rest in
    unary as a bit vector in which each value of the high part ends with a
    zero; ``zeros`` counts the zeros before each 64-bit word, for selection.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros
        self.mask = np.uint64((1 << width) - 1)
        self.ones: np.ndarray | None = None  # ones before each word, on first use

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = min(60, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        low = _packed(values & np.uint64((1 << width) - 1), width)
        top = (values >> np.uint64(width)).astype(np.int64)
        size = n + (max(universe - 1, 0) >> width) + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        bits[size:] = 1  # no zeros behind the end
        high = np.packbits(bits, bitorder="little").view("<u8")
        count = 64 - np.bitwise_count(high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(count)])[:-1].astype(np.uint32)
        return cls(n, width, low, high, zeros)

    def save(self, path: str) -> None:
        saved(f"{path}.shape.npy", np.array([self.n, self.width]))
        for name in ("low", "high", "zeros"):
            saved(f"{path}.{name}.npy", getattr(self, name))

    @classmethod
    def load(cls, path: str) -> EliasFano:
        n, width = np.load(f"{path}.shape.npy").tolist()
        return cls(n, width, *(np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("low", "high", "zeros")))

    @functools.cached_property
    def last(self) -> np.uint64:
        """The largest number."""
        return self.access(np.array([self.n - 1]))[0]

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the ``k``-th zero, from 0."""
        at = np.searchsorted(self.zeros, k.astype(np.uint32), "right") - 1
        left = (k - self.zeros[at]).astype(np.int64)
        word, place = ~self.high[at], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= ones
            left -= ones * on
            place += half * on
            word = np.where(on, word >> np.uint64(half), word)
        return at * 64 + place

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        ahead = (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off)
        return ((self.low[word] >> off) | ahead) & self.mask

    def _top(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(self.width)).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number that is at least ``x`` (``n`` if there is none)."""
        x = np.asarray(x, np.uint64)
        top = self._top(x)
        end = self.select0(top) - top
        start = np.where(top > 0, self.select0(np.maximum(top - 1, 0)) - (top - 1), 0)
        want = x & self.mask
        live = np.flatnonzero(start < end)
        lo, hi = start.copy(), end.copy()
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def find_between(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of each ``x`` among the numbers from place ``begin`` to before ``end``, or -1: a search for its successor there.

        Only places that share the high part of ``x`` are looked at.
        """
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = np.asarray(x, np.uint64)
        top = self._top(x)
        lo = np.maximum(begin, np.where(top > 0, self.select0(np.maximum(top - 1, 0)) - (top - 1), 0))
        stop = np.minimum(end, self.select0(top) - top)
        hi, want = np.maximum(stop, lo), x & self.mask
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        same = (lo < stop) & (self.lows(np.minimum(lo, self.n - 1)) == want)
        return np.where(same, lo, -1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each ``x``, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = np.asarray(x, np.uint64)
        at, top = self.successor(x), self._top(x)
        inside = at < self.select0(top) - top
        same = inside & (self.lows(np.minimum(at, self.n - 1)) == (x & self.mask))
        return np.where(same, at, -1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at ``i``; by search over zeros, for pointers that are read in small numbers."""
        i = np.asarray(i, np.int64)
        if self.ones is None:
            self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        at = np.searchsorted(self.ones, i, "right") - 1
        left, word, place = i - self.ones[at], self.high[at].copy(), np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= count
            left -= count * on
            place += half * on
            word = np.where(on, word >> np.uint64(half), word)
        top = (at * 64 + place - i).astype(np.uint64)
        return (top << np.uint64(self.width)) | self.lows(i)
