"""Words of a text as bytes, and helpers for Arrow batches.

A word is a maximal run of characters other than space and U+0009..U+000D,
which is what ``bytes.split()`` without arguments splits by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text column (null: 0), in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of an Arrow batch. Texts of some kilobytes make batches of some megabytes, in Python and in the JVM.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of rows a batch, unless it is as low already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class WordHashes(dict):
    """64-bit hash of a word; remembers the frequent ones, within a fixed bound."""

    LIMIT = 1 << 16

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column) -> list:
    """Texts of an Arrow column as UTF-8 bytes, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        return [x for c in column.chunks for x in c.cast(pa.binary()).to_pylist()]
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(texts: list, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def rolling(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = np.uint64(base)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= b
        out += hashes[j : n + j]
    return out


def starts_within(counts: np.ndarray, width: int) -> np.ndarray:
    """Of all runs over documents laid end to end, which lie within one document."""
    total = int(counts.sum())
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(total, bool)
    ends = np.cumsum(counts)
    for j in range(1, width):  # the last width-1 words of a document start no run of it
        at = ends - j
        ok[at[(at >= 0) & (at >= ends - counts)]] = False
    return ok[:n]
