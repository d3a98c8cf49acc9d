"""Words and shingles of whole text columns, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; all work is on
UTF-8 bytes, where these rules are the same as on characters.  Words and
shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _GOLDEN)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = raw(column)[1][1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte of, and the byte after, every word, in order; ``space`` tells which byte values are in no word."""
    n = len(data)
    inside = ~space[data]
    first = np.zeros(n + 1, bool)  # where a text begins
    first[offsets[:-1]] = True
    first = first[:n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~first[1:]
    return starts, np.flatnonzero(inside & ~after) + 1


_NEAR = 64
_CELL_VALUES = mix(np.arange(1, _NEAR * 256 + 1, dtype=_U) * _GOLDEN)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> np.ndarray:
    """Hash of every word: the sum of a value for each byte at its place in the word, mixed with the length."""
    if not len(starts):
        return np.zeros(0, _U)
    body, first = data[starts[0] :], starts - starts[0]
    cell = np.arange(len(body)) - np.repeat(first, np.diff(first, append=len(body)))
    cell <<= 8
    cell |= _LOWER[body]
    values = _CELL_VALUES.take(cell, mode="clip")
    far = np.flatnonzero(cell >= len(_CELL_VALUES))
    values[far] = mix((cell[far] + 1).astype(_U) * _GOLDEN)
    values[space[body]] = 0
    return mix(np.add.reduceat(values, first) + (ends - starts).astype(_U) * _GOLDEN)


class Hashes:
    """Hashes of any short stretch of lower-cased bytes, from prefix sums.

    Polynomials modulo 2^64 have pairs of long texts that collide (from about
    a thousand bytes on), so whole words are told apart by word_hashes() instead.
    """

    def __init__(self, data: np.ndarray):
        powers = np.full(len(data), _BASE, _U)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        self._sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE_VALUES[_LOWER[data]] * powers, out=self._sums[1:])
        self._inverse = powers
        self._inverse[:] = _BASE_INVERSE
        self._inverse[:1] = 1
        np.multiply.accumulate(self._inverse, out=self._inverse)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(_U) * _GOLDEN)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    starts, ends = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def shingles(word: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle; a row of 1 to k-1 words has one, of all its words."""
    if not len(word):
        return word, row

    def joined(start: np.ndarray, length: int) -> np.ndarray:
        x = np.full(len(start), length, _U)
        for i in range(length):
            x = mix(x * _GOLDEN + word[start + i])
        return x

    per_row = np.bincount(row, minlength=rows)
    start = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
    parts = [(joined(start, k), row[start])]
    first = np.concatenate([[0], np.cumsum(per_row)[:-1]])
    for length in range(1, k):
        short = np.flatnonzero(per_row == length)
        if len(short):
            parts.append((joined(first[short], length), short))
    hashes, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(parts) > 1:
        order = np.argsort(at, kind="stable")
        hashes, at = hashes[order], at[order]
    return hashes, at


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after another, and the offsets of the texts."""
    data, offsets = raw(column)
    rows = len(offsets) - 1
    hashes, at = shingles(*words(data, offsets), rows, k)
    bounds = np.searchsorted(at, np.arange(rows + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(sets) if sets else np.zeros(0, _U), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
