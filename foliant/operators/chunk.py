"""Documents to overlapping passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.vectors import text_pieces


def _pack(text: str, separator: str, size: int) -> list[str]:
    """Pieces of a text cut after every separator, joined again while they fit; over-size ones stay alone."""
    *head, last = text.split(separator)
    packed, room = [], 0
    for piece in [h + separator for h in head] + [last]:
        if packed and len(piece) <= room:
            packed[-1] += piece
            room -= len(piece)
        else:
            packed.append(piece)
            room = max(size - len(piece), 0) if len(piece) <= size else -1
    return packed


def split_text(text: str, size: int) -> list[str]:
    """Cut a text into pieces of at most ``size``, at the coarsest separator that does it."""
    pieces = [text]
    for separator in fv.SEPARATORS:
        if all(len(p) <= size for p in pieces):
            return pieces
        pieces = [q for p in pieces for q in (_pack(p, separator, size) if len(p) > size else [p])]
    return [p[i:i + size] for p in pieces for i in range(0, max(len(p), 1), size)]


def overlap_tail(piece: str, overlap: int) -> str:
    """End of a piece that is repeated in front of the next one, from a word start if there is one."""
    tail = piece[-overlap:]
    cut = tail.find(" ") + 1
    return tail[cut:] if 0 < cut < len(tail) else tail


def chunk_text(text: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> list[str]:
    """Passages of one text."""
    base = [p for p in map(str.strip, split_text(text, size)) if p]
    if overlap <= 0:
        return base
    return base[:1] + [f"{overlap_tail(a, overlap)} {b}".strip() for a, b in zip(base, base[1:])]


def pieces(text: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Array of the passages of a text column."""

    @F.arrow_udf("array<string>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            for part in text_pieces(texts):
                yield pa.array([chunk_text(t or "", size, overlap) for t in part], pa.list_(pa.string()))

    return run(text)


def chunk_documents(docs: DataFrame, text: str = "text", *, size: int = fv.CHUNK_SIZE,
                    overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Passages of documents that are one segment each: no row moves between tasks.

    Adds ``ordinal`` and ``content`` and drops ``text``; a document without text gives no row.
    """
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode_outer(pieces(F.col(text), size, overlap)).alias("ordinal", "content")).where("ordinal IS NOT NULL")


def chunk_segments(segments: DataFrame, keys: list[str], *, seg_no: str = "seg_no", page: str = "page", text: str = "text",
                   size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Passages of documents made of segments: ``keys``, ``page``, ``ordinal`` and ``content``.

    Pieces under 20 characters are dropped unless the document has a single segment. One shuffle by document:
    the ordinal of a piece is its place in the segment plus the pieces of the segments before. A document has at most
    1000 pages, so its window is small.
    """
    document = Window.partitionBy(*keys)
    before = document.orderBy(seg_no).rowsBetween(Window.unboundedPreceding, -1)
    cut = segments.select(*keys, seg_no, page, pieces(F.col(text), size, overlap).alias("__all"))
    counted = cut.withColumn("__single", F.count("*").over(document) == 1)
    kept = counted.withColumn("__kept", F.filter(
        "__all", lambda p: F.col("__single") | (F.length(p) >= fv.MIN_PIECE_CHARS)))
    placed = kept.withColumn("__start", F.coalesce(F.sum(F.size("__kept")).over(before), F.lit(0)))
    rows = placed.select(*keys, page, "__start", F.posexplode_outer("__kept").alias("__pos", "content")).where("__pos IS NOT NULL")
    return rows.select(*keys, page, (F.col("__start") + F.col("__pos")).cast("int").alias("ordinal"), "content")


def document_rollup(chunks: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Passages and suspicious passages per document, with the model that made the vectors."""
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunk_count"),
        F.sum(F.col("suspicious").cast("int")).alias("suspicious_chunks"),
    ).withColumn("embed_model", F.lit(model))


def documents_without_text(docs: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that produced no passage; they are errors."""
    return docs.join(chunks.select(*keys).distinct(), keys, "left_anti").withColumn(
        "error", F.lit(fv.NO_INDEXABLE_TEXT))
