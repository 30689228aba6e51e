"""Texts of an Arrow batch as flat numpy arrays: words, word hashes, shingles.

Everything here works on slices of a few megabytes, so that memory stays
bounded by the slice (or by one document, if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

#: ASCII white space: the word separators of the contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
BYTE_HASH = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(BASE, 4096)


def byte_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes data[s:s+n]; runs ascend and don't overlap."""
    global _POW
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lens.max() > len(_POW):
        _POW = powers(BASE, int(lens.max()) * 2)
    at = np.cumsum(lens) - lens
    n = int(lens.sum())
    off = np.arange(n, dtype=np.int32) - np.repeat(at.astype(np.int32), lens)
    src = np.repeat(starts.astype(np.int32), lens) + off
    v = BYTE_HASH[data[src]]
    v *= _POW[off]
    return mix(np.add.reduceat(v, at) + lens.astype(np.uint64) * BASE)


@dataclass
class Texts:
    """A slice of a batch: rows first..last, their bytes (nulls empty) and where each row's bytes begin."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column of that exact name (the first, should names clash)."""
    return batch.column(batch.schema.names.index(name))


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    n = len(arr)
    if not n:
        return
    valid = np.asarray(arr.is_valid())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield Texts(a, b, data[off[a] : off[b]], off[a : b + 1] - off[a], valid[a:b])
        a = b
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps idle workers for a while, and they would sit on it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


@dataclass
class Words:
    starts: np.ndarray
    lens: np.ndarray
    #: Words of row i are number first[i] to first[i + 1].
    first: np.ndarray


def words(t: Texts, inside: np.ndarray) -> Words:
    """Runs of bytes for which inside[byte] holds; no run crosses from one text to the next."""
    w = inside[t.data]
    if not len(w):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64))
    before = np.empty(len(w), bool)
    before[0] = False
    before[1:] = w[:-1]
    edges = t.offsets[:-1][t.offsets[:-1] < len(w)]
    before[edges] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(len(w), bool)
    after[-1] = False
    after[:-1] = w[1:]
    edges = t.offsets[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return Words(starts, ends - starts, np.searchsorted(starts, t.offsets))


NOT_SPACE = ~SPACE


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive word hashes of one run (empty if it is shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = h[:n].copy()
    for i in range(1, k):
        x *= BASE
        x += h[i : i + n]
    return mix(x)
