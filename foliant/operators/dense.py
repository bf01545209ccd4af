"""Exact inner-product search of many questions at once.

Passages and questions are packed into blocks (vectors of one organisation in one binary value). Passages that lie near each other share a block, which
knows its pivot and the largest angle between the pivot and any of its vectors: so no vector of the block can be nearer to a question than the question's
angle to the pivot less that angle. Blocks meet on the organisation; a task takes them in the order of that bound, multiplies matrices, and leaves out a
block as soon as its bound lies below the least score that each question's pool has by then. It keeps the best ``pool`` passages per question for everything it
has seen, and a window takes the best of these. No pair of a passage and a question ever becomes a row unless it is among the best of a task, or
asked for by name. The question side is broadcast only if Spark finds it small enough; if not, the blocks are shuffled, and the blocks of an organisation
are spread over keys by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

BLOCK = 256
#: Blocks of an organisation that meet on one key.
TOGETHER = 16
STEP = 8  # blocks between two looks at the bounds
SCORE_DIGITS = 6
SLACK = 1e-5  # scores are rounded, and vectors are floats
HELD_ROWS = 200_000  # results a task keeps before it passes them on; how many does not change the ranking
MET = 32  # pairs of blocks a task takes apart at a time: each holds two matrices
SENT = 16_000_000  # bytes of questions that go to all tasks at most, so that passages stay where they are
PARTS = "qkey bigint, chunk_id bigint, document_id bigint, sim double, kind int"
PARTS_ARROW = pa.schema([("qkey", pa.int64()), ("chunk_id", pa.int64()), ("document_id", pa.int64()), ("sim", pa.float64()), ("kind", pa.int32())])
BEST, WANTED, REPORT = 0, 1, 2


def near_first(matrix: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which near ones stand together: by the nearest of some of them."""
    if len(matrix) <= block:
        return np.arange(len(matrix))
    pivots = matrix[::max(1, block // 4)]
    return np.argsort((matrix @ pivots.T).argmax(1), kind="stable")


def pivot_of(matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """Direction of a block and the largest angle to any of its vectors; an angle of pi, which bounds nothing, if they have not length one."""
    x = matrix.astype(np.float64)
    middle = x.sum(0)
    length = np.linalg.norm(middle)
    if length < 1e-9 or np.abs(np.linalg.norm(x, axis=1) - 1).max() > 1e-4:
        return middle * 0, np.pi
    middle /= length
    return middle, float(np.arccos(np.clip((x @ middle).min(), -1, 1)))


def pack(vectors: DataFrame, id_col: str, vector: str, block: int = BLOCK, document: str | None = None, wanted: str | None = None) -> DataFrame:
    """``org, dim, ids, documents, matrix, pivot, angle, wanted``: blocks of one organisation and one dimension, built where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (org, dim), rows in batch.groupby(["org", batch["vector"].str.len()], sort=False):
                whole = np.vstack(rows["vector"].to_numpy()).astype(np.float32)
                order = near_first(whole, block)
                for i in range(0, len(rows), block):
                    at = order[i:i + block]
                    part, matrix = rows.iloc[at], whole[at]
                    pivot, angle = pivot_of(matrix)
                    lists = [np.asarray(w if w is not None else [], np.int64) for w in part["wanted"]]
                    asked = np.stack([np.repeat(part["id"].to_numpy(np.int64), [len(w) for w in lists]), np.concatenate(lists)]) if lists else np.empty((2, 0), np.int64)
                    out.append((org, int(dim), part["id"].to_numpy(np.int64).tobytes(), part["document"].to_numpy(np.int64).tobytes(), matrix.tobytes(),
                                pivot.tobytes(), angle, asked.tobytes()))
            yield pd.DataFrame(out, columns=["org", "dim", "ids", "documents", "matrix", "pivot", "angle", "wanted"])

    rows = vectors.select(
        F.col("org").cast("string").alias("org"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(document) if document else F.lit(0), F.lit(0)).cast("bigint").alias("document"),
        F.col(vector).alias("vector"), (F.col(wanted) if wanted else F.lit(None)).cast("array<bigint>").alias("wanted")).where("vector IS NOT NULL AND size(vector) > 0")
    return rows.mapInPandas(run, "org string, dim int, ids binary, documents binary, matrix binary, pivot binary, angle double, wanted binary")


def _cut(keys: np.ndarray, ids: np.ndarray, documents: np.ndarray, sims: np.ndarray, pool: int) -> tuple[np.ndarray, ...]:
    """The best ``pool`` of every question, equal scores by passage id."""
    order = np.lexsort((ids, -sims, keys))
    keys, ids, documents, sims = keys[order], ids[order], documents[order], sims[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    place = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    kept = place < pool
    return keys[kept], ids[kept], documents[kept], sims[kept]


def _least(held: tuple[np.ndarray, ...], keys: np.ndarray, pool: int) -> np.ndarray:
    """The score that a passage must reach to enter each question's pool: none while the pool is not full."""
    out = np.full(len(keys), -np.inf)
    if len(held[0]):
        asked, first, many = np.unique(held[0], return_index=True, return_counts=True)  # held rows are sorted by question, best first
        full = many >= pool
        at = np.searchsorted(asked, keys)
        known = (at < len(asked)) & (asked[np.minimum(at, len(asked) - 1)] == keys)
        at = np.minimum(at, len(asked) - 1)
        out = np.where(known & full[at], held[3][np.minimum(first + pool - 1, len(held[0]) - 1)][at], out)
    return out


def _score_blocks(pool: int) -> Callable:
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def frame(kept: tuple[np.ndarray, ...], kind: int) -> pd.DataFrame:
        return pd.DataFrame({"qkey": kept[0], "chunk_id": kept[1], "document_id": kept[2], "sim": kept[3], "kind": kind})

    def named(group: pd.DataFrame, keys: np.ndarray, right: np.ndarray, dim: int) -> tuple[np.ndarray, ...]:
        """Scores of the passages that questions ask for by name, as far as they are in these blocks."""
        asked, ids = np.frombuffer(group["wanted"].iloc[0], np.int64).reshape(2, -1), np.frombuffer(b"".join(group["ids"]), np.int64)
        if not asked.shape[1] or not len(ids):
            return none
        order = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], asked[1], side) for side in ("left", "right"))
        found = np.flatnonzero(last > first)
        if not len(found):
            return none
        at = order[first[found]]
        left = np.frombuffer(b"".join(group["matrix"]), np.float32).reshape(len(ids), dim)[at].astype(np.float64)
        by_key = np.argsort(keys)
        row = by_key[np.searchsorted(keys[by_key], asked[0][found])]
        sims = np.round(np.einsum("ij,ij->i", right[row], left), SCORE_DIGITS) + 0.0
        return asked[0][found], ids[at], np.frombuffer(b"".join(group["documents"]), np.int64)[at], sims

    def best(group: pd.DataFrame, keys: np.ndarray, right: np.ndarray, dim: int, held: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], int]:
        """The best of one block of questions, given what is held, and how many blocks of passages were left out."""
        pivots = np.frombuffer(b"".join(group["pivot"]), np.float64).reshape(len(group), dim)
        lengths = np.linalg.norm(right, axis=1)
        away = np.arccos(np.clip(right @ pivots.T / np.maximum(lengths, 1e-12)[:, None], -1, 1)) - group["angle"].to_numpy()
        bound = np.where((group["angle"].to_numpy() < np.pi)[None, :], np.cos(np.maximum(away, 0)) * lengths[:, None] + SLACK, np.inf)
        order, left_out = np.argsort(-bound.max(0), kind="stable"), 0
        for i in range(0, len(order), STEP):
            least = _least(held, keys, pool)
            at = [k for k in order[i:i + STEP] if (bound[:, k] >= least).any()]
            left_out += len(order[i:i + STEP]) - len(at)
            if not at:
                continue
            part = group.iloc[at]
            ids, documents = (np.frombuffer(b"".join(part[c]), np.int64) for c in ("ids", "documents"))
            left = np.frombuffer(b"".join(part["matrix"]), np.float32).reshape(len(ids), dim).astype(np.float64)
            sims = np.round(right @ left.T, SCORE_DIGITS) + 0.0
            if len(ids) > pool:
                least = np.maximum(least, np.partition(sims, len(ids) - pool, axis=1)[:, len(ids) - pool])
            row, column = np.nonzero(sims >= least[:, None])
            found = keys[row], ids[column], documents[column], sims[row, column]
            held = _cut(*[np.concatenate(x) for x in zip(held, found)], pool)
        return held, left_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in scored(batches):
            yield pa.RecordBatch.from_pandas(part, PARTS_ARROW, preserve_index=False)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held, met, left_out = {}, 0, 0  # held: by block of questions
        for batch in (b.slice(i, MET).to_pandas() for b in batches for i in range(0, b.num_rows, MET)):
            for (dim, _), group in batch.groupby(["dim", "qids"], sort=False):
                keys = np.frombuffer(group["qids"].iloc[0], np.int64)
                right = np.frombuffer(group["qmatrix"].iloc[0], np.float32).reshape(len(keys), int(dim)).astype(np.float64)
                yield frame(named(group, keys, right, int(dim)), WANTED)
                at = int(dim), group["qids"].iloc[0]
                held[at], skipped = best(group, keys, right, int(dim), held.get(at, none))
                met, left_out = met + len(group), left_out + skipped
            if sum(len(kept[0]) for kept in held.values()) > HELD_ROWS:
                yield from (frame(kept, BEST) for kept in held.values())
                held = {}
        yield from (frame(kept, BEST) for kept in held.values() if len(kept[0]))
        yield frame(tuple(np.array([x], t) for x, t in ((0, np.int64), (met, np.int64), (left_out, np.int64), (0.0, float))), REPORT)

    return run


def scored_blocks(vectors: DataFrame, questions: DataFrame, pool: int, *, block: int = BLOCK) -> DataFrame:
    """Rows of all tasks: the best of each, passages asked for by name (``wanted`` of a question), and how many blocks a task met (in ``chunk_id``) and left out
    (in ``document_id``)."""
    asked = staged(pack(questions, "qid", "qvec", block, wanted="wanted" if "wanted" in questions.columns else None), "blocks")
    document = "document_id" if "document_id" in vectors.columns else None
    columns = ["dim", "ids", "documents", "matrix", "pivot", "angle", "qids", "qmatrix", "wanted"]
    right = asked.select("org", "dim", F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"), "wanted")
    if (asked.agg(F.sum(F.length("matrix") + F.length("wanted"))).first()[0] or 0) <= SENT:
        # every task meets all questions: no block of passages goes through a shuffle
        named = vectors.withColumn("org", F.col("org").cast("string")).join(F.broadcast(asked.select("org")), "org", "left_semi")
        left = pack(named, "chunk_id", "embedding", block, document).drop("wanted")
        return left.join(F.broadcast(right), ["org", "dim"]).select(*columns).mapInArrow(_score_blocks(pool), PARTS)
    # how many keys an organisation's blocks are spread over: a row for each organisation that is asked for, written so that its size is known
    sizes = vectors.groupBy("org").agg(F.ceil(F.count("*") / F.lit(block * TOGETHER)).cast("int").alias("spreads"))
    sizes = staged(sizes.join(questions.select("org").distinct(), "org", "left_semi").select(F.col("org").cast("string").alias("org"), "spreads"), "sizes")
    held = vectors.withColumn("org", F.col("org").cast("string")).join(sizes.select("org"), "org", "left_semi")
    left = pack(held, "chunk_id", "embedding", block, document).drop("wanted")
    left = left.join(sizes, "org").withColumn("spread", F.pmod(F.xxhash64("ids"), F.col("spreads")).cast("int")).drop("spreads")
    right = right.join(sizes, "org").select(*right.columns, F.explode(F.sequence(F.lit(0), F.col("spreads") - 1)).alias("spread"))
    met = left.join(right, ["org", "dim", "spread"]).select(*columns)
    return met.mapInArrow(_score_blocks(pool), PARTS)


def dense_topk(vectors: DataFrame, questions: DataFrame, pool: int, *, block: int = BLOCK) -> DataFrame:
    """``qid, chunk_id, sim, dense_rank``: the ``pool`` nearest passages of each question's organisation, with ``document_id`` if ``vectors`` has it.

    ``vectors``: org, chunk_id, embedding. ``questions``: qid (bigint), org, qvec, and optionally ``wanted``, ids of passages whose ``sim`` is needed too: they
    come with a null rank unless they are among the nearest. Passages whose vector has another dimension than the question's do not take part.
    """
    part = scored_blocks(vectors, questions, pool, block=block).where(F.col("kind") != REPORT).withColumnRenamed("qkey", "qid")
    part = part if "document_id" in vectors.columns else part.drop("document_id")
    if "wanted" not in questions.columns:
        return rank_dense(part.drop("kind"), pool)
    order = Window.partitionBy("qid").orderBy("kind", F.desc("sim"), "chunk_id")
    ranked = part.withColumn("dense_rank", F.row_number().over(order)).withColumn("dense_rank", F.when((F.col("kind") == BEST) & (F.col("dense_rank") <= pool), F.col("dense_rank")))
    carried = [F.max(c).alias(c) for c in part.columns if c == "document_id"]
    return ranked.where((F.col("kind") == WANTED) | F.col("dense_rank").isNotNull()).groupBy("qid", "chunk_id").agg(*carried, F.max("sim").alias("sim"), F.max("dense_rank").alias("dense_rank"))


def pruning_report(vectors: DataFrame, questions: DataFrame, pool: int, *, block: int = BLOCK) -> DataFrame:
    """``met, left_out``: blocks that met a block of questions, and how many of them were left out by their bounds."""
    rows = scored_blocks(vectors, questions, pool, block=block).where(F.col("kind") == REPORT)
    return rows.agg(F.coalesce(F.sum("chunk_id"), F.lit(0)).alias("met"), F.coalesce(F.sum("document_id"), F.lit(0)).alias("left_out"))


def rank_dense(scored: DataFrame, pool: int) -> DataFrame:
    """Rank scored pairs per question; Spark cuts to ``pool`` before the shuffle as well."""
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "chunk_id")
    return scored.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= pool)
