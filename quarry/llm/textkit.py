"""Vectorised word and hash helpers over Arrow string buffers.

All functions work on one slice of whole texts at a time: the UTF-8 bytes of
several rows side by side plus their row offsets. Words are maximal runs of
bytes other than space and 0x09-0x0D (UTF-8 continuation bytes never collide
with those). Hashes are 64-bit: a random-byte-table polynomial, evaluated for
every word from one prefix sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer single text is one slice of its own).
SLICE_BYTES = 2 << 20

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse; kept for slices of usual size only."""
    if len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    both = []
    for base in (_MULT, _U(pow(int(_MULT), -1, 2**64))):
        p = np.full(n + 1, base, _U)
        p[0] = 1
        both.append(np.cumprod(p, dtype=_U))
    if n <= SLICE_BYTES:
        _POWERS[:] = both
    return both[0], both[1]


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string column; nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay within ``limit`` (one row at least)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


class Words:
    """Words of one slice: byte ``start``/``end`` and ``row``; lower-cased (A-Z) word hashes on demand."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~_SEP[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        self.end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.bounds = np.searchsorted(self.start, offsets)
        self._prefix = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            n = len(self.raw)
            up, _ = _powers(n)
            h = np.zeros(n + 1, _U)
            np.cumsum(_VALUES[_LOWER[self.raw]] * up[:n], out=h[1:])
            self._prefix = h
        return self._prefix

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte span (lower-cased), independent of where it stands."""
        h = self.prefix()
        down = _powers(len(self.raw))[1]
        return mix((h[end] - h[start]) * down[start] + (end - start).astype(_U) * _MULT)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def words_of(raw: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> Words:
    return Words(raw[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start])


_STEP = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``k``-word shingles.

    A row with 1 to k-1 words has one shingle, its whole sequence; a row
    without words has none.
    """
    h = words.hashes()
    n = len(h)
    rows = len(words.offsets) - 1
    full = np.zeros(max(n - k + 1, 0), _U)
    if n >= k:
        for i in range(k):
            full += h[i:n - k + 1 + i] * _STEP[i]
    full = mix(full)
    out = []
    for r in range(rows):
        a, b = words.bounds[r], words.bounds[r + 1]
        if b - a >= k:
            out.append(np.unique(full[a:b - k + 1]))
        elif b > a:
            short = (h[a:b] * _STEP[:b - a]).sum(dtype=_U, keepdims=True)
            out.append(mix(short + np.full(1, b - a, _U) * _MULT))
        else:
            out.append(np.zeros(0, _U))
    return out


def list_column(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> column of uint64 arrays."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
