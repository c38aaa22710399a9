"""Texts of an Arrow batch as numpy arrays: bytes, words and lines of many texts at once, without a Python loop a word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more entry than texts). Nulls are empty."""
    column = pa.compute.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def chunks(begins: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about that many bytes in all; a longer text is alone."""
    low = 0
    while low < len(begins) - 1:
        high = max(low + 1, int(np.searchsorted(begins, begins[low] + most, "right")) - 1)
        yield low, high
        low = high


def release() -> None:
    """Gives freed memory back to the system: a worker lives on, and stays as large as its largest batch otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        made = np.full(size, _POWER, np.uint64)
        made[0] = 1
        _powers = np.multiply.accumulate(made)
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and (one more entry than texts) how many words stand before each text."""
    inside = ~SPACE[data]
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0] = True
        edge[1:] = ~inside[:-1]
        firsts = begins[:-1][begins[:-1] < len(data)]
        edge[firsts] = True
    starts = np.flatnonzero(edge & inside)
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = ~inside[1:]
        ends_at = begins[1:][begins[1:] > 0] - 1
        last[ends_at] = True
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, begins)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal spans have equal hashes. Spans ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(before, lengths)
    values = (data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, before) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text; a shorter text, if it has words, is one run."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        out = mixed(out + words[j : j + n]) if j + n <= len(words) else out
    return out
