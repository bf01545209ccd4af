"""A Merkle manifest of a dataset: one digest for all rows, and for each row a proof that it belongs to that digest.

Rows of a group (a language) are leaves in the order of their keys; every eight consecutive nodes become one, until one is left. The groups' last nodes are
joined in the same way. So the whole is a forest of trees below one more tree.

*Blocks.* Aligned subtrees of ``HEIGHT`` levels are built and kept by one task each: a block of 8 ** HEIGHT leaves, whose root is a leaf of the
blocks above, which are made in the same way until one is left. No task holds more than a block, however large a group is.

*Layout.* A block keeps its nodes in van Emde Boas order: the tree is cut at half its height, the upper part comes first, then the lower
subtrees from left to right, each part laid out by the same rule. Where a node lies follows from its depth and number by arithmetic alone, so
construction and the retrieval of siblings store no pointers, and a path through a block touches few cache lines whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 8
HEIGHT = 4
DIGEST = 64


def spelled(value: Column) -> Column:
    """A value so that no two rows spell the same: its bytes' count, a colon and the value, or ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    """SHA-256 of a row as lower-case hexadecimal text."""
    return F.sha2(F.concat(*[spelled(v) for v in values]).cast("binary"), 256)


def joined(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def size_of(levels: int) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def place(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (the root has 0) lie in a full tree of ``levels`` levels of nodes."""
    start = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        lower = levels - upper
        if depth < upper:
            levels = upper
        else:
            depth -= upper
            below = FANOUT**depth
            start += size_of(upper) + index // below * size_of(lower)
            index, levels = index % below, lower
    return start


@lru_cache
def places(levels: int, depth: int) -> np.ndarray:
    """Of all nodes of a depth, kept as long as the worker lives: one array for each depth of a block."""
    return place(levels, depth, np.arange(FANOUT**depth))


def needed_height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FANOUT), height + 1
    return height


def block_height(total: int, height: int) -> int:
    """A block's height: the whole tree's if that is lower, as one block then holds it all."""
    return min(height, needed_height(total))


def built(leaves: list[bytes], height: int) -> np.ndarray:
    """Nodes of a block from its leaves, in their places; places after the last one in use are cut off."""
    levels, row = height + 1, leaves
    rows = [row]
    for _ in range(height):
        row = [joined(row[i:i + FANOUT]) for i in range(0, len(row), FANOUT)]
        rows.append(row)
    at = [places(levels, height - k)[:len(r)] for k, r in enumerate(rows)]
    out = np.zeros(max(int(a.max()) for a in at) + 1, f"S{DIGEST}")
    for a, r in zip(at, rows):
        out[a] = r
    return out


def siblings(nodes: np.ndarray, height: int, leaves: int, index: int) -> list[tuple[bytes, bytes]]:
    """For each level from a leaf up to the block's root, the digests of the run before and after the node, joined."""
    levels, out = height + 1, []
    for k in range(height):
        first = index // FANOUT * FANOUT
        run = nodes[places(levels, height - k)[first:min(first + FANOUT, leaves)]].tolist()
        out.append((b"".join(run[:index - first]), b"".join(run[index - first + 1:])))
        index, leaves = index // FANOUT, -(-leaves // FANOUT)
    return out


def folded(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The digest at the end of a path from a leaf and the siblings on the way."""
    for before, after in steps:
        leaf = sha256(before + leaf + after).hexdigest().encode()
    return leaf


STEPS = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
STEPS_SQL = "array<struct<before:binary,after:binary>>"


def step_rows(steps: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    return pa.array([[{"before": a, "after": b} for a, b in s] for s in steps], STEPS)


def ranked(nodes: DataFrame, order: list[Column], rows_per_range: int, rows: int) -> DataFrame:
    """``nodes`` (with ``grp``) and each row's ``rank`` from 0 in the order within its group, and the group's ``total``.

    Rows are cut into ranges of the whole order; a row comes after the rows of its group in earlier ranges, which are counted. Rows that are equal in the whole order
    go to several ranges, and to any of the ranks that they share.
    """
    columns = nodes.columns
    spread = nodes.withColumn("tie", F.monotonically_increasing_id())
    ranges = max(1, -(-rows // rows_per_range))
    keys = [F.col("grp"), *order, F.col("tie")]
    parted = spread.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("tie")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parted.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a range are sorted by group: each one's number within its group and range."""
        part, current, following = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            groups = batch.column("grp")
            codes = groups.dictionary_encode()
            at = codes.indices.to_numpy()
            edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
            numbers = np.empty(len(at), np.int64)
            for a, b in zip(edges, [*edges[1:], len(at)]):
                name = groups[int(a)].as_py()
                following = following if name == current else 0
                numbers[a:b] = np.arange(following, following + b - a)
                current, following = name, following + int(b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(numbers)], names=[*batch.schema.names, "part", "place"])

    placed = written(parted.mapInArrow(number, f"{fields}, part int, place long"), "placed")
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("grp", "part", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total"))
    return placed.join(starts, ["grp", "part"]).select(*columns, (F.col("start") + F.col("place")).alias("rank"), "total")


def block_rows(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks of ``nodes(grp, rank, total, digest)``: ``grp, block, total, root`` and ``nodes``, the digests in their places."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        total = table.column("total")[0].as_py()
        held = built([x.encode() for x in table.column("digest").to_pylist()], block_height(total, height))
        return pa.table({"grp": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()]), "total": pa.array([total]),
                         "root": pa.array([held[0].decode()]), "nodes": pa.array([held.tobytes()], pa.binary())})

    return (nodes.withColumn("block", F.floor(F.col("rank") / F.lit(FANOUT**height)).cast("long")).groupBy("grp", "block")
            .applyInArrow(build, "grp string, block long, total long, root string, nodes binary"))


def levels_of(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and ``grp, digest``: the last node of every group."""
    stored, tops = [], None
    while True:
        blocks = written(block_rows(nodes, height), "blocks")
        stored.append(blocks)
        last = blocks.where(F.col("total") <= FANOUT**height).select("grp", F.col("root").alias("digest"))
        tops = last if tops is None else tops.unionByName(last)
        rest = blocks.where(F.col("total") > FANOUT**height)
        if rest.isEmpty():
            return stored, tops
        nodes = rest.select("grp", F.col("block").alias("rank"), F.ceil(F.col("total") / F.lit(FANOUT**height)).cast("long").alias("total"), F.col("root").alias("digest"))


def held_by(key: tuple, blocks: pa.Table, height: int) -> tuple[np.ndarray, int, int, list[tuple[bytes, bytes]]]:
    """Nodes, height and number of leaves of one block, and the steps from its root up."""
    total = blocks.column("total")[0].as_py()
    above = [(s["before"], s["after"]) for s in blocks.column("steps")[0].as_py()]
    return (np.frombuffer(blocks.column("nodes")[0].as_py(), f"S{DIGEST}"), block_height(total, height), min(FANOUT**height, total - key[1].as_py() * FANOUT**height), above)


def steps_below(blocks: DataFrame, height: int) -> DataFrame:
    """``grp, rank, steps`` of every leaf of ``blocks(grp, block, total, nodes, steps)``: the way from the leaf to the end of the block's own ``steps``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        nodes, levels, leaves, above = held_by(key, table, height)
        first = key[1].as_py() * FANOUT**height
        return pa.table({"grp": pa.array([key[0].as_py()] * leaves), "rank": pa.array(np.arange(first, first + leaves)),
                         "steps": step_rows([siblings(nodes, levels, leaves, i) + above for i in range(leaves)])})

    return blocks.groupBy("grp", "block").applyInArrow(run, f"grp string, rank long, steps {STEPS_SQL}")


def with_steps(stored: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The lowest of the ``stored`` blocks with the steps from their roots up; ``tops(grp, steps)`` has the steps from the last node of every group."""
    below = None
    for blocks in reversed(stored):
        ends = blocks.where(F.col("total") <= FANOUT**height).join(tops, "grp")
        rows = ends.select("grp", "block", "total", "nodes", "steps")
        if below is not None:
            inner = blocks.where(F.col("total") > FANOUT**height).join(below.withColumnRenamed("rank", "block"), ["grp", "block"])
            rows = rows.unionByName(inner.select("grp", "block", "total", "nodes", "steps"))
        rows = written(rows, "steps")
        if blocks is stored[0]:
            return rows
        below = steps_below(rows, height)


def manifest(rows: DataFrame, key: str, group: Column, digest: Column, tampered: Column | None = None, height: int = HEIGHT, rows_per_range: int = 200_000) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``digest`` is a row's leaf, ``group`` (a string, null allowed) its tree. ``tampered`` is the leaf as found later, null where it is the same: the path is folded from it and
    verified if it ends at the root. Leaves stand in the order of their keys, nulls first, and of their digests where keys are equal; groups in the order of
    their bytes, null first. Repeated rows are leaves of their own, side by side. A single row is its own root, with no siblings. An empty table gives no row. Columns other than those named are not read.
    """
    kind = rows.schema[key].dataType.simpleString()
    # null sorts first and is no group's name
    name = F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group))
    found = F.coalesce(tampered, digest) if tampered is not None else digest
    leaves = rows.select(name.alias("grp"), F.col(key).alias("key"), digest.alias("digest"), F.nullif(found, digest).alias("other"))
    placed = written(ranked(leaves, [F.col("key").asc_nulls_first(), F.col("digest")], rows_per_range, rows.count()), "leaves")
    stored, subroots = levels_of(placed.select("grp", "rank", "total", "digest"), height)
    subroots = written(subroots, "subroots")
    # the groups' tree: they are the leaves of one group, by name
    order = ranked(subroots.select(F.lit("all").alias("grp"), F.col("grp").alias("name"), "digest"), [F.col("name")], rows_per_range, subroots.count())
    order = written(order, "groups")
    upper, top = levels_of(order.select("grp", "rank", "total", "digest"), height)
    root = (top.first() or {"digest": None})["digest"]
    none = F.array().cast(STEPS_SQL)
    highest = with_steps(upper, top.select("grp", none.alias("steps")), height)
    from_groups = order.join(steps_below(highest, height).select("rank", "steps"), "rank").select(F.col("name").alias("grp"), "steps")
    lowest = with_steps(stored, from_groups, height).join(subroots.withColumnRenamed("digest", "subroot"), "grp")

    def run(at: tuple, found: pa.Table, blocks: pa.Table) -> pa.Table:
        nodes, levels, leaves, above = held_by(at, blocks, height)
        tail = b"".join(a + b for a, b in above)
        end = root.encode()
        proofs, ends = [], []
        for rank, leaf, other in zip(found.column("rank").to_pylist(), found.column("digest").to_pylist(), found.column("other").to_pylist()):
            steps = siblings(nodes, levels, leaves, rank % FANOUT**height)
            proofs.append(sha256(b"".join(a + b for a, b in steps) + tail).hexdigest())
            ends.append(folded((other or leaf).encode(), steps + above).decode())
        many = found.num_rows
        return pa.table({"key": found.column("key"), "leaf": found.column("digest"), "subroot": pa.array(blocks.column("subroot").to_pylist() * many, pa.string()),
                         "root": pa.array([root] * many, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(ends, pa.string()),
                         "verified": pa.array([x.encode() == end for x in ends], pa.bool_())})

    block = F.floor(F.col("rank") / F.lit(FANOUT**height)).cast("long")
    out = (placed.withColumn("block", block).groupBy("grp", "block").cogroup(lowest.groupBy("grp", "block"))
           .applyInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"))
    return out.withColumnRenamed("key", key)
