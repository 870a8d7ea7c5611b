"""Vectorised NumPy kernels over Arrow string buffers.

Every function works on the UTF-8 bytes of a batch of texts at once, so that
no per-word Python object is made.  ``chunks`` cuts a batch into groups of whole
texts of about ``limit`` bytes; memory is bounded by that or by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: White space bytes: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and leaves other bytes.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}
#: What empties the caches that operators keep in a Python worker beyond a task.
CACHES: list[Callable[[], None]] = []


def release() -> None:
    """Empty the caches of other operators, which a reused worker still holds, and give unused memory back."""
    for empty in CACHES:
        empty()
    trim()


def trim() -> None:
    """Give memory that is free back to the system: Arrow's and, where the C library can, that of its heap."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; small tables are kept."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        made = np.full(max(n, 1 << 19), base, dtype=U64)
        made[0] = 1
        kept = np.cumprod(made, dtype=U64)
        if len(kept) <= 1 << 21:
            _POWERS[base] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of byte * BASE**position, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes of equal length hash alike wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the maximal runs without white space; n+1 counts."""
    if len(data) == 0:
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, np.zeros(len(offsets), dtype=np.int64)
    space = IS_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows of each text, and n+1 bounds.

    A text of fewer words has one shingle, its whole word sequence; a text without words has none.
    """
    n = np.diff(bounds)
    per = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(n)), per)
    first = bounds[text] + (np.arange(len(text)) - out_bounds[text])
    value = np.zeros(len(text), dtype=U64)
    length = np.minimum(n[text], size)
    for j in range(size):
        at = np.minimum(first + j, max(len(hashes) - 1, 0))
        part = hashes[at] * U64(pow(BASE, 2 * j + 1, 2**64)) if len(hashes) else np.zeros(0, dtype=U64)
        value += part if j == 0 else np.where(j < length, part, U64(0))
    return mix(value + length.astype(U64)), out_bounds


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def segment_min(values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    """Minima of the segments; empty segments give ``empty``."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.minimum.reduceat(values, bounds[:-1][full])
    return out
