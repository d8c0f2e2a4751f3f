"""Vectorised hashes of words and word shingles over a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Lower-case table for A-Z, and which bytes are white space of the contracts.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Longest run of bytes hashed at once; a batch of texts is cut to about this.
BLOCK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that looks random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: A random value for each byte value at each place of a word; places repeat after 64 with a factor.
_PLACES = mixed(np.arange(64 * 256, dtype=np.uint64) * _GOLD + np.uint64(1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and the n + 1 offsets of its texts; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    if column.offset:
        column = pa.array(column.to_pylist(), pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)), offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of every word, and the n + 1 offsets of each text's words."""
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts_of_texts] = ~space[starts_of_texts]
    start = np.flatnonzero(first)
    filled = np.concatenate([[0], np.cumsum(~space)])
    length = np.diff(filled[start], append=filled[-1])
    return start, length, np.searchsorted(start, offsets).astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the n + 1 offsets of each text's words."""
    start, length, counts = word_bounds(data, offsets)
    if not len(start):
        return np.empty(0, np.uint64), counts
    begin = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(begin, length)
    letters = data[place + np.repeat(start, length)]
    value = _PLACES[((place & 63) << 8) | (LOWER[letters] if lower else letters)]
    far = place > 63
    if far.any():
        value[far] = mixed(value[far] + (place[far] >> 6).astype(np.uint64) * _GOLD)
    return mixed(np.add.reduceat(value, begin)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every shingle of width words, and each text's offsets; a shorter text with a word is one shingle."""
    n = np.diff(counts)
    made = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(counts[:-1], made) + np.arange(ends[-1]) - np.repeat(ends[:-1], made)
    size = np.repeat(np.minimum(n, width), made)
    h = size.astype(np.uint64)
    for k in range(width):
        use = size > k
        nxt = mixed(h * _GOLD + words[np.where(use, at + k, 0)]) if len(words) else h
        h = np.where(use, nxt, h)
    return h, ends
