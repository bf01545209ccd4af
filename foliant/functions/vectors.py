"""Vector functions: feature hashing, a hook for other models, inner products."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

PIECE_ROWS, PIECE_BYTES = 1024, 4_000_000
_WORDS = re.compile(r"\w+")
#: A worker forgets its words beyond this many, so its memory does not grow with the vocabulary.
MOST_WORDS = 200_000
TABLE_BYTES = 64  # of the longest word that a table can be moved past


@dataclass(frozen=True)
class Embedder:
    """A model: its name, its dimension and a function from a batch of texts to a matrix, whose rows need no scaling."""

    name: str
    dim: int
    embed: Callable[[Sequence[str]], np.ndarray]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    matrix = np.asarray(matrix, dtype=np.float32)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


class _Hashed(dict):
    """Words met so far, numbered. By number: the CRC of a word, of a word and an underscore, and the word's bytes."""

    def __init__(self):
        self.crc, self.opened, self.size = (np.zeros(1024, kind) for kind in (np.uint32, np.uint32, np.int64))

    def __missing__(self, word: str) -> int:
        at, data = len(self), word.encode()
        if at == len(self.crc):
            self.crc, self.opened, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.crc, self.opened, self.size))
        self.crc[at] = crc = zlib.crc32(data)
        self.opened[at], self.size[at] = zlib.crc32(b"_", crc), len(data)
        self[word] = at
        return at


_met = _Hashed()


@cache
def _moved() -> np.ndarray:
    """What n zero bytes make of a CRC, by n, place of a byte in it and that byte: the CRC of two texts in a row is that of the first, moved by the second's bytes, with an
    exclusive or of the second's."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    moved = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(TABLE_BYTES):
        moved.append((moved[-1] >> 8) ^ one[moved[-1] & 255])
    return np.stack(moved)


def _pair_codes(words: list[str], at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRCs of the pairs of words that begin at the places ``first``: no pair is written out unless its second word is very long."""
    second = at[first + 1]
    crc, size, moved = _met.opened[at[first]], _met.size[second], _moved()
    n = np.minimum(size, TABLE_BYTES)
    codes = moved[n, 0, crc & 255] ^ moved[n, 1, (crc >> 8) & 255] ^ moved[n, 2, (crc >> 16) & 255] ^ moved[n, 3, crc >> 24] ^ _met.crc[second]
    for i in np.flatnonzero(size > TABLE_BYTES):
        codes[i] = zlib.crc32(f"{words[first[i]]}_{words[first[i] + 1]}".encode())
    return codes


def hash_features(texts: Sequence[str], dim: int = fv.HASH_DIM) -> np.ndarray:
    """Signed feature hashing of words and word pairs, one row per text."""
    global _met
    if len(_met) > MOST_WORDS:
        _met = _Hashed()
    words, counts = [], []
    for text in texts:
        found = _WORDS.findall(text.lower())
        words += found
        counts.append(len(found))
    at, owner = np.array([*map(_met.__getitem__, words)], np.int64), np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(owner[1:] == owner[:-1])
    code = np.concatenate([_met.crc[at], _pair_codes(words, at, first)]).astype(np.int64)
    slot = np.concatenate([owner, owner[first]]) * dim + code % dim
    sign = ((code >> 16) & 1) * 2.0 - 1.0
    sums = np.bincount(slot, weights=sign, minlength=len(counts) * dim)
    return sums.reshape(len(counts), dim)


def hash_embedder(dim: int = fv.HASH_DIM) -> Embedder:
    return Embedder(f"hash-{dim}", dim, lambda texts: hash_features(texts, dim))


def text_pieces(texts: pa.Array, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch in pieces of at most ``rows`` texts and about ``size`` bytes, so that a task's memory follows a piece, not ten thousand texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, before + size, "right"))), start + rows)
        yield texts.slice(start, stop - start).to_pylist()
        start = stop


def embed_column(text: Column, model: Embedder, batch: int = fv.EMBED_BATCH) -> Column:
    """Unit vectors of a text column. A text that occurs again within a piece of an Arrow batch is embedded once; a task holds the vectors of one piece at a time."""

    @F.arrow_udf("array<float>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            for part in text_pieces(texts):
                codes, distinct = pd.factorize(np.array([t or "" for t in part], dtype=object))
                parts = [unit_rows(model.embed(list(distinct[i:i + batch]))) for i in range(0, len(distinct), batch)]
                matrix = np.vstack(parts)[codes]
                offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
                yield pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), pa.float32()))

    return run(text)


def inner_product(left: Column, right: Column) -> Column:
    """Inner product of two arrays, in double precision, inside the JVM."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
