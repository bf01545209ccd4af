"""Helpers shared by the operators: staged tables, word names, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Word patterns of the queries, for SQL; :func:`plain_words` and :func:`letter_words` split the same way.
PLAIN = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = bytes(range(256)).lower()
LETTER_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)
#: A worker forgets its word names beyond this many, so its memory does not grow with the vocabulary.
MOST_NAMES = 300_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. Its shuffle files go when it is written: later steps read the table, never ``df``."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return staged(df, name)
    finally:
        conf.set(CLEANUP, before)


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def plain_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space. ``bytes.split`` knows just these six characters."""
    return text.split()


def letter_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case."""
    return text.translate(LETTER_TABLE).split()


class Names(dict):
    """64-bit names of words, the same in every task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_NAMES:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(names: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit name for each run of ``size`` names, by first position."""
    n = len(names) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + names[i:i + n])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's BIGINT."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, lengths, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with few texts at a time, so that a task's memory follows one long text, not ten thousand."""
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(text).to_pylist()
            start = stop
