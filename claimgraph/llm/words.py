"""Vectorised words of whole texts, shared by the operators that work on words or shingles.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8 text, A-Z lower-cased on request.
All functions take an Arrow string or binary array and work on its value buffer, so a batch costs a few
numpy passes over its bytes and no Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(values: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``values``, and for each text the index of its first word (len + 1); ``outside`` tells
    which bytes belong to no word."""
    inside = ~outside[values]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(values)]
    start[cuts] = inside[cuts]  # a text starts a word of its own
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    end[cuts] = inside[cuts]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight at a time; equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(values) + 8, np.uint8)
    padded[: len(values)] = LOWER[values] if lower else values
    eights = np.ndarray(shape=(len(values) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    out = left.astype(np.uint64)
    at, rows = starts, None
    while True:
        step = mix64((out if rows is None else out[rows]) * np.uint64(0xD6E8FEB86659FD93) + (eights[at] & _MASK[np.minimum(left, 8)]))
        if rows is None:
            out = step
        else:
            out[rows] = step
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles and the index of each text's first one (len + 1).

    A text with 1 to size - 1 words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    padded = np.concatenate([hashes, np.zeros(size - 1, np.uint64)])
    every = np.full(len(hashes), np.uint64(size))
    for k in range(size):  # at every word; those that would run over a text's end are left out below
        every = every * np.uint64(0xD6E8FEB86659FD93) + (padded[k : k + len(hashes)] ^ (every >> np.uint64(29)))
    start = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    out = mix64(every[start])
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = np.uint64(counts[row])
        with np.errstate(over="ignore"):
            for h in hashes[first[row] : first[row + 1]]:
                own = own * np.uint64(0xD6E8FEB86659FD93) + (h ^ (own >> np.uint64(29)))
        out[at[row]] = mix64(np.array([own]))[0]
    return out, at
