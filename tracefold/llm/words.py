"""Vectorised word hashes of Arrow text columns, and five-word shingles.

Words are runs of bytes other than the ASCII white space 20 and 09-0D, with A-Z
lower-cased. A word is told by a 64-bit hash; two different words of a corpus
share one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def grow(base: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:
            out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
        return out[:n]

    return grow(_BASE), grow(_INVERSE)


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES):
    """(first row, last row + 1, bytes, byte offsets) of runs of rows; a long text stands alone."""
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + block_bytes, side="right")) - 1)
        end = min(end, n)
        yield k, end, raw[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        k = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and one past the last)."""
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    low = _LOWER[raw]
    ink = np.concatenate((~_SPACE[low], [False]))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], ink[:-1]))
    starts = np.flatnonzero(ink & (~before | edge))
    ends = np.flatnonzero(before & (~ink | edge))
    size = 1 << max(20, (n + 1).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h += (ends - starts).astype(np.uint64)
    return mix(h), np.searchsorted(starts, offsets)


def shingle_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of the ``width`` words from each place on (the last places lack some and are not given)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    s = h[:n] * _WEIGHTS[0]
    for j in range(1, width):
        s += h[j : j + n] * _WEIGHTS[j]
    s += np.uint64(width)
    return mix(s)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Each row's sorted distinct shingles; the whole text is one shingle when it has fewer words."""
    h, first = word_hashes(raw, offsets)
    s = shingle_hashes(h, width)
    first = first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= width:
            yield np.unique(s[a : b - width + 1])
        elif b > a:
            yield shingle_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)
