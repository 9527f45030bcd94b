"""Vectorised word and shingle hashing over Arrow string arrays.

Texts are handled as UTF-8 bytes, some megabytes at a time: words are runs of bytes outside a separator
class, their 64-bit hashes come from one running sum, and nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def byte_class(codes: list[int]) -> np.ndarray:
    """A 256-entry table that is true for the given byte values."""
    out = np.zeros(256, bool)
    out[codes] = True
    return out


#: Separators of whitespace words: space and U+0009 to U+000D.
BLANKS = byte_class([0x20, *range(0x09, 0x0E)])
#: Separators of alphanumeric words: every ASCII byte but digits and letters.
NON_ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        for name, base in (("up", _STEP), ("down", _STEP_INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[:1] = 1
            _powers[name] = np.multiply.accumulate(factors)
        _powers["n"] = n
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of some consecutive rows: ``rows`` counts them, ``first`` is their first row's number."""

    first: int
    rows: int
    row: np.ndarray  # of each word, from 0
    start: np.ndarray  # of each word, in bytes of ``data``
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    row_start: np.ndarray  # rows + 1 offsets into ``data``

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def as_strings(texts: pa.Array) -> pa.LargeStringArray:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_string()).fill_null("")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about ``limit`` bytes; a row is never cut."""
    texts = as_strings(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(texts: pa.Array, separators: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of every row, A-Z hashed as a-z; null texts have none."""
    for first, data, offsets in slices(texts, limit):
        rows, n = len(offsets) - 1, len(data)
        if not n:
            empty = np.empty(0, np.int64)
            yield Words(first, rows, empty, empty, empty, np.empty(0, np.uint64), data, offsets)
            continue
        inside = ~separators[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < n]
        opens[heads] |= inside[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        closes[tails] |= inside[tails]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _steps(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        row = np.searchsorted(offsets, start, "right") - 1
        yield Words(first, rows, row, start, end, mix((total[end] - total[start]) * down[start]), data, offsets)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row with fewer words gives its whole sequence once."""
    n, row, h = len(found.row), found.row, found.hash
    full = max(n - size + 1, 0)
    sums = np.zeros(full, np.uint64)
    for k in range(size):
        sums += h[k : k + full] * _PLACE[k]
    inside = row[:full] == row[size - 1 : size - 1 + full] if full else np.empty(0, bool)
    rows, hashes = [row[:full][inside]], [mix(sums[inside])]
    counts = found.counts()
    begins = np.cumsum(counts) - counts
    for few in range(1, size):
        own = np.flatnonzero(counts == few)
        if len(own):
            short = np.full(len(own), few, np.uint64)
            for k in range(few):
                short += h[begins[own] + k] * _PLACE[k]
            rows.append(own)
            hashes.append(mix(mix(short)))
    if len(rows) == 1:
        return rows[0], hashes[0]
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by both."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """rows + 1 offsets of sorted row numbers."""
    return np.searchsorted(row, np.arange(rows + 1))
