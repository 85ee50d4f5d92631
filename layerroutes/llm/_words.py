"""Words of UTF-8 texts as 64-bit numbers, for whole Arrow batches at once.

A word is a run of bytes other than ASCII space and tab to carriage return. Its number is a
polynomial over the bytes with random coefficients, taken from running sums and then mixed;
two words of one text share a number with a chance of about 2**-58."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240611))
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 20
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. A chunk's are kept; a longer stretch's are not."""
    if n <= CHUNK and "up" in _tables:
        return _tables["up"], _tables["down"]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, CHUNK), base, dtype=np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if n <= CHUNK:
        _tables["up"], _tables["down"] = made
    return made[0], made[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def binary(column: pa.Array) -> pa.Array:
    """A text column as bytes with 64-bit offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets of each text in them."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about CHUNK bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        yield lo, hi
        lo = hi


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words never cross from one text to the next."""
    gap = SPACE[data]
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1


def numbers(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words, the index of each text's first word (and one past the last),
    and the words' starts and ends. A text beyond a chunk is cut at white space."""
    if not len(data):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    start, end = bounds(data, offsets)
    return hashes(data, start, end, lower), np.searchsorted(start, offsets), start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Numbers of the stretches start to end, which are in order and not empty. Stretches are
    taken about a chunk of bytes at a time, a longer one alone."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, side="right")))
        a, b = int(start[lo]), int(end[hi - 1])
        up, down = _powers(b - a)
        part = data[a:b]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[LOWER[part] if lower else part] * up[: b - a], out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_INVERSE))
        lo = hi
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n-word windows of one stretch of words; fewer words make one window."""
    k = min(n, len(h))
    if not k:
        return np.empty(0, np.uint64)
    x = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        x += h[j : len(h) - k + 1 + j] * _STEP[j]
    return mixed(x)
