"""Vectorised reading of many texts at once: bytes, words, lines and their hashes, in numpy.

Texts are handled as UTF-8 bytes. All separators of the word rule are ASCII, so cutting bytes equals cutting characters.
Strings are compared by 64-bit polynomial hashes over random byte values; a hash of any range costs two lookups.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are handled at once; temporary arrays take about 100 times as much.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.RandomState(20_240_607).randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Caches of operators whose workers hold much; a task of another operator empties them.
_kept: list[dict] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = n + n // 4 + 1
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[start:end], mixed with the length."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def fixed(self, length: int) -> np.ndarray:
        """Of all ranges of `length` values, unmixed."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length : length + n] - self.sums[:n]) * self.down[:n]


class Scan:
    """Texts side by side, each followed by a space.

    `begin[d]`, `end[d]`: where text d lies in `data`; `word_start`, `word_end`, `word_doc`: all words in order;
    `first_word[d]`: index of the first word of text d (one entry more than texts).
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts) + b" "
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # bytes.lower touches A-Z only
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes
        space = _SPACE[self.data]
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        self.word_start, self.word_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.space = space
        self.first_word = np.searchsorted(self.word_start, np.append(self.begin, len(self.data)))
        self.n_words = np.diff(self.first_word)
        self.word_doc = np.repeat(np.arange(len(texts)), self.n_words)
        self._ranges: Ranges | None = None

    @property
    def bytes(self) -> Ranges:
        if self._ranges is None:
            self._ranges = Ranges(_VALUES[self.data])
        return self._ranges

    def words(self) -> np.ndarray:
        return self.bytes.hash(self.word_start, self.word_end)

    def per_doc(self, at_byte: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(at_byte, out=total[1:])
        return total[self.end] - total[self.begin]


def shingles(words: np.ndarray, first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `k` consecutive words of one text, and the text of each; a text with 1 to k - 1 words has its whole sequence as one."""
    n_docs, sizes = len(first_word) - 1, np.diff(first_word)
    grams = mix(Ranges(words).fixed(k)) if len(words) >= k else np.zeros(0, np.uint64)
    counts = np.maximum(sizes - k + 1, 0)
    doc = np.repeat(np.arange(n_docs), counts)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_word[:-1], counts)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        whole = Ranges(words).hash(first_word[short], first_word[short + 1])
        return np.concatenate([grams[starts], whole]), np.concatenate([doc, short])
    return grams[starts], doc


def give_back() -> None:
    """Returns memory that is free in this process to the machine: a Python worker lives on after its task, and others need the room."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # made anew in milliseconds
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def keep(cache: dict) -> dict:
    """`cache`, which stays in a worker until a task of another operator reads texts there."""
    _kept.append(cache)
    return cache


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK, own: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column `text` has about `limit` bytes in each; a longer text comes alone. Before the first, all caches of `keep` but
    `own` are emptied; after the last, free memory is given back."""
    for cache in _kept:
        if cache is not own:
            cache.clear()
    yield from cut(batches, limit)
    give_back()


def cut(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.fromiter((len(x) for x in texts(batch)), np.int64, batch.num_rows)
        group = (np.cumsum(sizes + 32) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def texts(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 bytes of column `text`; null is empty."""
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], ..."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def set_aside(docs: DataFrame) -> DataFrame:
    """`docs` with all columns but doc_id and text under names that no operator uses."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"__{k}" for k, c in enumerate(docs.columns)))
