"""Vectorised text primitives over Arrow buffers.

A block is (data, offsets): the bytes of consecutive texts, end to end, and
where each begins. Blocks hold about BLOCK bytes, or one longer text, so the
arrays made from them stay small whatever the size of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What separates words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

U = np.uint64


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives its memory back at the end: Python workers outlive their tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values for a seed."""
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64) + U(seed * 1_000_003)) + U(seed))


_BYTE = randoms(256, 11)
_BASE, _INVERSE = 0x5851F42D4C957F2B, pow(0x5851F42D4C957F2B, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK + 2), base, np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] a polynomial of data[i:j]; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    h = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U(0xA24BAED4963EE407))


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if len(col) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(col: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) over a column, about limit bytes at a time."""
    data, offsets = column(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that cross no text: starts, ends, and each text's first run (n+1)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of non-space bytes, as spans() gives them."""
    return spans(~SPACE[data], offsets)


_PLACE = randoms(64, 23) | U(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles, sorted within each text, and each text's first (n+1).

    A text with fewer words than width has its whole sequence as one shingle;
    one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    total = int(out_at[-1])
    text = np.repeat(np.arange(len(n)), count)
    start = first[:-1][text] + (np.arange(total) - out_at[:-1][text])
    x = np.zeros(total, np.uint64)
    full = n[text] >= width
    for j in range(width):
        ok = full | (j < n[text])
        x[ok] += hashes[start[ok] + j] * _PLACE[j]
    x[~full] += n[text[~full]].astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)
    x = mix(x)
    fresh = np.ones(total, bool)
    for lo, hi in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        if hi - lo > 1:
            x[lo:hi].sort()
    fresh[1:] = x[1:] != x[:-1]
    fresh[out_at[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return x[fresh], kept[out_at]


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[first[i]:first[i+1]]."""
    values = np.ascontiguousarray(values)
    at = np.asarray(first, np.int64) * values.itemsize
    if at[-1] > np.iinfo(np.int32).max:
        raise ValueError(f"a binary column of {at[-1]} bytes is too large for one batch")
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def regroup(values: np.ndarray, buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """values ordered by bucket, and each bucket's first (n+1)."""
    order = np.argsort(buckets, kind="stable")
    return values[order], np.searchsorted(buckets[order], np.arange(n + 1))
