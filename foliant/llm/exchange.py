"""Questions from blocks of documents about names, and answers gathered over all blocks.

A block is a group of documents of a few megabytes, by a hash of key and text. It asks about each of its names once; names are dealt by their upper bits,
so that a part of all names meets in one task, whose size is set by the number of parts. Rows carry packed arrays, not single names: what is shuffled is one row
for each block and part, never one for each word. A name that all documents hold is asked for once by each block. Names are sorted, so answers
fit whatever the order in which a block's documents arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

BLOCK_BYTES = 4_000_000
#: Bytes of text for each part of the names.
PART_BYTES = 16_000_000


def once(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, many``: each distinct pair of key and text once. Rows that repeat would all fall into one block; without any, the rows stay as they are."""
    digest = F.md5(as_bytes(text)).alias("digest")
    if rows.groupBy(key, digest).count().where("count > 1").isEmpty():
        return rows.select(key, text, F.lit(1).cast("long").alias("many"))
    return written(rows.groupBy(key, digest).agg(F.any_value(text).alias(text), F.count("*").alias("many")).drop("digest"), "once")


def repeated_again(results: DataFrame, together: int = 10_000) -> DataFrame:
    """Every row ``many`` times, without that column."""
    thousands = results.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("many") - 1) / F.lit(together)))))
    here = F.least(F.lit(together), F.col("many") - F.col("__part") * together)
    return thousands.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), here))).drop("many", "__part", "__one")


class Blocks:
    """Documents dealt to blocks: rows ``block, key, content``; null texts are empty. ``parts`` is the number of parts for names."""

    def __init__(self, docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES):
        self.size = size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        many = max(1, -(-size // block_bytes))
        self.parts = max(1, -(-size // part_bytes))
        self.kind = docs.schema[key].dataType.simpleString()
        self.docs = docs.select(F.pmod(F.xxhash64(key, text), F.lit(many)).alias("block"), F.col(key).alias("key"), as_bytes(text).alias("content"))

    def map(self, handle: Callable, schema: str, **answers: DataFrame) -> DataFrame:
        """``handle(block, keys, texts, *answers)`` yields record batches; each answer is the joined bytes of its parts, none where the block had no names."""
        names = list(answers)

        def one(table: pa.Table, *got: bytes) -> pa.Table:
            made = list(handle(table.column("block")[0].as_py(), table.column("key").combine_chunks(), table.column("content").to_pylist(), *got))
            return pa.Table.from_batches(made)

        if not answers:
            return self.docs.groupBy("block").applyInArrow(lambda table: one(table), schema)

        def both(table: pa.Table, replies: pa.Table) -> pa.Table:
            replies = replies.sort_by("part")
            got = {n: [] for n in names}
            for what, data in zip(replies.column("what").to_pylist(), replies.column("data").to_pylist()):
                got[what].append(data)
            return one(table, *[got[n] for n in names])

        union = None
        for name, reply in answers.items():
            rows = reply.where("block >= 0").select("block", "part", "data", F.lit(name).alias("what"))
            union = rows if union is None else union.unionByName(rows)
        return self.docs.groupBy("block").cogroup(union.groupBy("block")).applyInArrow(both, schema)


def packed(names: np.ndarray) -> bytes:
    """Sorted names as differences, byte by byte in turn: their upper bytes are few values, which the shuffle's compression takes away."""
    return np.ascontiguousarray(np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    flat = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8")[:, 0] if data else np.empty(0, "<u8")
    return np.cumsum(flat, dtype=np.uint64)


def edges_of(names: np.ndarray, parts: int) -> np.ndarray:
    """Where each part starts among sorted names."""
    return np.searchsorted((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def requested(block: int, names: np.ndarray, parts: int, *extras: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of a block's question: sorted distinct names, and arrays that go along with them."""
    edges = edges_of(names, parts)
    filled = np.flatnonzero(edges[1:] > edges[:-1])
    cut = [(edges[p], edges[p + 1]) for p in filled]
    yield pa.RecordBatch.from_arrays(
        [pa.array(filled + kind * parts, pa.int64()), pa.array([block] * len(filled), pa.int64()), pa.array([packed(names[a:b]) for a, b in cut], pa.binary()),
         *[pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in extras]],
        names=["part", "block", "names", *[f"x{i}" for i in range(len(extras))]])


def asked(extras: int) -> str:
    return "part long, block long, names binary" + "".join(f", x{i} binary" for i in range(extras))


def answered(requests: DataFrame, kinds: list, merge: Callable) -> DataFrame:
    """Apply ``merge(part, names, extras)``, all lists by block, to each part. It returns the answer to each block as bytes, aligned with its names, and
    may return the sums of the part, which go out as the answer to block -1."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        names = [unpacked(x) for x in table.column("names").to_pylist()]
        extras = [[np.frombuffer(x, kind) for x in table.column(f"x{i}").to_pylist()] for i, kind in enumerate(kinds)]
        part = table.column("part")[0].as_py()
        replies, *sums = merge(part, names, extras)
        return pa.table({"block": pa.array(table.column("block").to_pylist() + [-1] * len(sums), pa.int64()), "part": pa.array([part] * (len(names) + len(sums)), pa.int64()),
                         "data": pa.array([*replies, *sums], pa.binary())})

    return requests.groupBy("part").applyInArrow(run, "block long, part long, data binary")


def grouped(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All names of a part in order: the permutation that sorts them, and where each distinct name starts."""
    flat = np.concatenate(names)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))


def dealt(values: np.ndarray, names: list[np.ndarray]) -> list[bytes]:
    """Values of all names, by block."""
    return [x.tobytes() for x in np.split(values, np.cumsum([len(x) for x in names])[:-1])]
