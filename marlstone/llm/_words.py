"""Words of whole Arrow text columns as numpy arrays: one pass over the bytes, no Python loop over words.

Hashes are polynomial in 64-bit arithmetic over random byte values, then mixed; a word's
hash depends on its (lower-cased) bytes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse."""
    if len(_pow[0]) <= n:
        m = max(n + 1, SLICE)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(m + 1, b, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _pow[k] = p
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its len + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE):
    """Ranges of rows with up to ``most`` bytes; a longer text is a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def prefix(data: np.ndarray) -> np.ndarray:
    """S with (S[e] - S[s]) * inverse**s the hash of data[s:e]."""
    p, _ = powers(len(data))
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_BYTE[data] * p[: len(data)], out=s[1:])
    return s


class Words:
    """Words of rows i .. j of a column: start and end in ``data``, row (from 0) and 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, kind: np.ndarray, lower: bool = True):
        base = offsets[i]
        d = data[base : offsets[j]]
        self.data = d = LOWER[d] if lower else d
        off = offsets[i : j + 1] - base
        inside = kind[d]
        n = len(d)
        edge = np.zeros(n + 1, bool)
        if n:
            edge[1:n] = inside[1:] != inside[:-1]
            edge[0] = inside[0]
            edge[n] = inside[-1]
        # a new row starts a new word
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        both = cuts[inside[cuts] & inside[cuts - 1]] if n else cuts
        marks = np.flatnonzero(edge)
        if len(both):
            marks = np.sort(np.concatenate([marks, both, both]) if len(both) == len(np.unique(both)) else np.concatenate([marks, np.repeat(np.unique(both), 2)]))
        self.starts, self.ends = marks[0::2], marks[1::2]
        self.offsets = off
        s = prefix(d)
        _, inv = powers(n)
        self.hash = mix((s[self.ends] - s[self.starts]) * inv[self.starts] + (self.ends - self.starts).astype(np.uint64))
        #: first[r] .. first[r + 1] are the words of row r
        self.first = np.searchsorted(self.starts, off)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, w: int) -> bytes:
        return self.data[self.starts[w] : self.ends[w]].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (len - n + 1 values)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _BASE + hashes[k : k + m]
    return mix(out)
