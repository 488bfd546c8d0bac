"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: Digits, letters and everything beyond ASCII.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Everything but white space.
SOLID = byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; ``x`` is not changed."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal runs of ``values``: a polynomial over each ``[start, end)``, mixed with its length."""
    up, down = powers(max(1, len(values)))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[np.minimum(starts, len(down) - 1)]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


#: Values that are hashed at once.
HASH_BLOCK = 1 << 18


def apart_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal runs of ``values``: each value is mixed with its place in its run before the run is summed.

    Costs a mix per value of every run, where ``span_hashes`` takes any number of
    overlapping runs; but no pattern of repeated values makes two runs meet, as
    it can in a polynomial modulo a power of two.
    """
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(len(starts), np.uint64)
    row = 0
    while row < len(starts):
        nxt = min(len(starts), max(row + 1, int(np.searchsorted(at, at[row] + HASH_BLOCK, "right")) - 1))
        first, n = at[row:nxt] - at[row], sizes[row:nxt]
        place = np.arange(at[nxt] - at[row]) - np.repeat(first, n)
        x = values[place + np.repeat(starts[row:nxt], n)].astype(np.uint64)
        x += (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x))])
        out[row:nxt] = total[first + n] - total[first]
        row = nxt
    return mix(out ^ (sizes.astype(np.uint64) << np.uint64(40)))


@dataclass
class Words:
    """Words of a chunk of texts: byte places, text index, and a hash of the lower-cased bytes."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more at the end


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(row, next row, bytes, offsets)`` of runs of rows that together have about ``most`` bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    wide = np.int64 if kind == pa.large_binary() else np.int32
    at = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        nxt = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        nxt = min(nxt, len(column))
        yield row, nxt, data[at[row] : at[nxt]], at[row : nxt + 1] - at[row]
        row = nxt


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> Words:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, doc, apart_hashes(LOWER[data], starts, ends), first)
