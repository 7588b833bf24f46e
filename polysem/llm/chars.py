"""Whole batches of texts as arrays: folding, slices of bounded size, words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SPACE = 32
SLICE_CHARS = 300_000
# Rows of an Arrow batch that are taken out of it at a time.
SLICE_ROWS = 256
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """For each code point that of its lower case, or a space if it is neither
    letter nor digit."""
    table = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def text_slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size, with the place of the first; a text above
    the limit is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that Python holds few texts at a time.
    Workers outlive their tasks: at the end, also of a failed task, what was freed goes back
    to the system."""
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(start, SLICE_ROWS)
    finally:
        release()


def release() -> None:
    """Give memory that nothing uses any more back to the system."""
    powers.cache_clear()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


# Rows and bytes of an Arrow batch where whole texts go to Python.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def lean(spark: SparkSession) -> None:
    """Arrow batches of few texts from here on, so that neither the JVM nor Python holds many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, a newline before each and at the end, and
    the place of the first of each text (with the end of all)."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return points, starts


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters, running sums of character x base^place, and what moves
    a difference of these to place 0."""
    return _sums_of(folding()[points])


def _sums_of(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 1 << max(20, int(len(seen)).bit_length())  # few sizes, so that powers are kept
    return seen, np.cumsum(seen * powers(BASE, size)[: len(seen)], dtype=np.uint64), powers(UNBASE, size)


def words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every run of letters and digits: the number of its text, its start and end
    within `points`, and a 64-bit hash of its folded characters."""
    return _runs(*_sums(points), starts)


def plain_words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of every run of 0-9, A-Z, a-z and characters above ASCII, of which
    only A-Z are folded."""
    low = points | ((points >= 65) & (points <= 90)).astype(np.uint32) << np.uint32(5)
    solid = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    return _runs(*_sums_of(np.where(solid, low, np.uint32(SPACE))), starts)


def _runs(seen: np.ndarray, sums: np.ndarray, back: np.ndarray, starts: np.ndarray) -> tuple:
    solid = seen != SPACE
    change = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    begin, end = change[::2], change[1::2]
    value = (sums[end - 1] - sums[begin - 1]) * back[begin]
    owner = np.searchsorted(starts, begin, side="right") - 1
    return owner, begin, end, mixed(value + (end - begin).astype(np.uint64))


def inner_grams(points: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every n characters in a row within a word: number of the text, start, and
    a hash that no word has on purpose."""
    seen, sums, back = _sums(points)
    runs = np.cumsum(seen != SPACE)
    begin = np.flatnonzero(runs[n:] - runs[:-n] == n) + 1
    value = (sums[begin + n - 1] - sums[begin - 1]) * back[begin]
    return np.searchsorted(starts, begin, side="right") - 1, begin, mixed(value + np.uint64((n << 40) + 1))


def plain_word_hashes(text: str) -> np.ndarray:
    """The hashes of the plain words of one text."""
    return plain_words(*code_points([text]))[3]


def word_hash(word: str) -> int:
    """The hash of one word, as above."""
    points, starts = code_points([word])
    return int(words(points, starts)[3][0])
