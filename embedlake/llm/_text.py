"""Vectorised text kernels over Arrow string buffers: words, their hashes, and safe segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words are ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S23 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(23)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * K2
    x = (x ^ (x >> _S27)) * K3
    return x ^ (x >> _S31)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows (from, to), bytes and offsets from 0, in runs of at most ``most`` bytes (or one row)."""
    raw, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _starts(offsets: np.ndarray) -> np.ndarray:
    return offsets[:-1][offsets[1:] > offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (with a closing entry); ``between`` flags the bytes of none."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = between[data]
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    s = _starts(offsets)
    first[s] = word[s]
    e = s[1:] - 1
    last[e] = word[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    at = np.ndarray((n + 1,), np.dtype("<u8"), padded, 0, (1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * K1 ^ (at[starts] & _MASK[np.minimum(left, 8)]))
    step, more = 8, np.flatnonzero(left > 8)
    while len(more):
        part = at[starts[more] + step] & _MASK[np.minimum(left[more] - step, 8)]
        h[more] = mix((h[more] * K1) ^ part)
        step += 8
        more = more[left[more] > step]
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n] * K1
    for j in range(1, k):
        out = ((out << _S23) | (out >> np.uint64(41))) * K3 + h[j : j + n]
    return mix(out + np.uint64(k))
