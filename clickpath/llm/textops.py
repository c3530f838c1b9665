"""Numpy helpers over the UTF-8 bytes of a batch of texts.

A batch is one ``uint8`` array and the offsets of its texts, as Arrow lays
strings out, so nothing here makes a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges ``(i, j)`` of texts of about ``limit`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(i, j, bytes, offsets)`` of the ranges of :func:`pieces`."""
    data, offsets = flat(column)
    for i, j in pieces(offsets, limit):
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def table(chars) -> np.ndarray:
    """A lookup table that is true at the given byte values."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes of a word `[^\x20\x09-\x0D]+`; UTF-8 keeps all other code points away from these bytes.
NOT_SPACE = ~table([0x20, *range(0x09, 0x0E)])
#: Lower case of A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text bounds of the maximal runs of ``inside`` bytes; runs end where their text ends."""
    mask = inside[data]
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(size, _P, U64), np.full(size, _P_INV, U64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, from one prefix sum of a polynomial."""
    if not len(starts):
        return np.zeros(0, U64)
    size = 1 << max(16, int(len(data)).bit_length())
    p, q = _powers(size)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbours of ``h``; also across texts, which callers mask out."""
    if len(h) < n:
        return np.zeros(0, U64)
    # the polynomial of a + b neighbours from those of a and of b, doubling
    out, have = None, 0
    power, size, factor = h, 1, _P
    while True:
        if n & size:
            out = power if out is None else out[:len(out) - size] * U64(factor) + power[have:]
            have += size
        if have == n:
            return mix(out)
        power = power[:len(power) - size] * U64(factor) + power[size:]
        factor = factor * factor % (1 << 64)
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    if len(h) < width:
        return h[:0]
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:len(h) - (width - have)], h[width - have:]) if width > have else h


def seg_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]`` along the first axis; 0 for empty ranges."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[:bounds[-1]], bounds[:-1][full], axis=0)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as sorted disjoint ones; touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return s[first], reach[np.append(first[1:] - 1, len(s) - 1)]


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow binary column of ``data[start:end]`` for each pair."""
    lens = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lens)
    out = data[index]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
