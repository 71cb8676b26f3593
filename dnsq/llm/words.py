"""Words, word hashes and shingles of many texts at once, as array operations on an Arrow buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ship

_CHUNK = 1 << 18  # bytes hashed at a time; a longer word is hashed in one go
_U = np.uint64


def _class(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


# Word bytes of the contracts. Bytes above 0x7F belong to letters beyond ASCII.
NOT_SPACE = _class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALPHANUMERIC = _class(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all of them."""
    h = h.copy()
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), or more of them; those of ordinary chunks are kept by the worker."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(n, _U(base))
        out[0] = 1
        out = np.cumprod(out, dtype=np.uint64)
        if n > _CHUNK:
            return out
        _POWERS[base] = out
    return _POWERS[base]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string array and the n + 1 offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z in lower case), row by row, and the number of words before each row."""
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    folded = _FOLD[data]
    word = inside[folded]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[firsts] = word[firsts]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = word[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        size = _CHUNK if hi - lo <= _CHUNK else hi - lo
        sums = np.empty(hi - lo + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[folded[lo:hi]] * _powers(_BASE, size)[: hi - lo], dtype=np.uint64, out=sums[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _powers(_INVERSE, size)[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, before: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word windows of each row. A row of fewer words, but not none, has
    one shingle: all its words."""
    factors = mix(np.arange(1, 2 * k + 2, dtype=np.uint64))
    n = len(hashes)
    if n >= k:
        full = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            full += hashes[i : n - k + 1 + i] * (factors[i] | _U(1))
        full = mix(full)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = (hashes[a:b] * (factors[: b - a] | _U(1))).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + factors[k + b - a : k + b - a + 1]))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def binaries(values: np.ndarray, starts) -> pa.Array:
    """Consecutive slices of an array as an Arrow binary column, without a copy per slice."""
    data = np.ascontiguousarray(values)
    at = np.asarray(starts, dtype=np.int64) * data.itemsize
    if len(data) * data.itemsize >= 1 << 31:
        raise ValueError("more than 2 GB in one batch")
    return pa.Array.from_buffers(
        pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


ship(__name__)
