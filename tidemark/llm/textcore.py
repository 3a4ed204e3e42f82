"""Words of UTF-8 text in Arrow buffers, hashed by vector operations without one Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is one segment of its own.
SEGMENT_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_pow = {"fwd": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["fwd"]) < n:
        size = max(n, SEGMENT_BYTES + 1)
        for key, base in (("fwd", _P), ("inv", _PINV)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _pow[key] = np.multiply.accumulate(factors)
    return _pow["fwd"], _pow["inv"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial over a random byte table, then mixed with the length."""
    fwd, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * fwd[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data, offsets


def segments(offsets: np.ndarray, most: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of rows with about ``most`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, row_starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that don't cross a row's start."""
    inside = is_word[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[row_starts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


WORD = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def hashed_words(column: pa.Array, is_word: np.ndarray = WORD, most: int = SEGMENT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first, last, hashes of all their words (A-Z lower-cased), and the n+1 word offsets of the rows."""
    data, offsets = utf8(column)
    for first, last in segments(offsets, most):
        part = LOWER[data[offsets[first] : offsets[last]]]
        rows = offsets[first : last + 1] - offsets[first]
        starts, ends = word_spans(part, rows[:-1], is_word)
        hashes = span_hashes(part, starts, ends)
        yield first, last, hashes, np.searchsorted(starts, rows)
