"""Whitening of embeddings with exact sums.

Entries become whole numbers, so counts, sums and the scatter matrix are exact whatever the order in which Spark adds them. Eigenvalues and components come
from the scatter's exact characteristic polynomial (:mod:`.charpoly`); its residues modulo many primes are computed by Spark tasks. What the driver
holds depends on the dimension of the vectors alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charpoly import Root, enough_primes, largest_roots, polynomial_mod, remaindered, vectors_of
from .common import lists, written

SCALE, OFFSET = 64, 1_000_000
#: Whole numbers beyond this are taken as this.
FURTHEST = 2**62
#: Digits of the exact sums that go through Spark's BIGINT sums.
DIGIT = 40
ROWS = 4096


def whole_entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of usable vectors of one length: their rows, and their entries as whole numbers without the offset."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        entries = values[starts[rows][:, None] + np.arange(length)]
        usable = np.isfinite(entries).all(1)
        with np.errstate(over="ignore"):
            z = np.floor(SCALE * entries[usable])
        yield rows[usable], np.clip(z, -FURTHEST, FURTHEST).astype(np.int64)


def packed(z: np.ndarray) -> list[bytes]:
    """Each vector as one byte for the width of its entries, and the entries: equal vectors are equal bytes."""
    out = [b""] * len(z)
    most = np.maximum(z.max(1), -1 - z.min(1))
    width = np.where(most < 2**7, 1, np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8)))
    for w in (1, 2, 4, 8):
        at = np.flatnonzero(width == w)
        data, size = z[at].astype(f"<i{w}").tobytes(), w * z.shape[1]
        for k, i in enumerate(at):
            out[i] = bytes((w,)) + data[k * size:(k + 1) * size]
    return out


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    width = np.array([r[0] for r in rows])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        data = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), -1)[:, 1:]
        out[at] = np.ascontiguousarray(data).view(f"<i{w}")
    return out


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and packed vectors of usable rows."""
    for batch in batches:
        for rows, z in whole_entries(batch.column("vector")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows)), pa.array([z.shape[1]] * len(rows), pa.int32()), pa.array(packed(z), pa.binary())], names=["key", "dim", "packed"])


def digits(value: int) -> Iterator[tuple[int, int]]:
    """Digits of a whole number in base 2 ** 40; the last has the sign."""
    k = 0
    while not -1 << DIGIT <= value < 1 << DIGIT:
        yield k, value & ((1 << DIGIT) - 1)
        value, k = value >> DIGIT, k + 1
    yield k, value


def products(z: np.ndarray) -> np.ndarray:
    """Exact products of all columns, as Python's whole numbers: by parts of 15 bits, whose products are exact in doubles."""
    parts, rest = [], z
    while np.abs(rest).max(initial=0) >= 2**20:
        parts.append((rest & 0x7FFF).astype(np.float64))
        rest = rest >> 15
    parts.append(rest.astype(np.float64))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) << 15 * (i + j)
    return total


def partial_sums(dim: int):
    """Vectors to the digits of their exact sums: rows ``i, j, digit, value``; sums of entries have j = -1, the count has both -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, sums, squares = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            column = batch.column("packed")
            for start in range(0, len(column), ROWS):
                z = unpacked(column.slice(start, ROWS).to_pylist(), dim)
                many += len(z)
                sums += ((z >> 31).sum(0).astype(object) << 31) + (z & (2**31 - 1)).sum(0).astype(object)
                squares += products(z)
        rows = [(-1, -1, many)] + [(i, -1, int(x)) for i, x in enumerate(sums)] + [(i, j, int(squares[i, j])) for i in range(dim) for j in range(i + 1)]
        out = [(i, j, k, v) for i, j, x in rows if many for k, v in digits(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "digit", "value"])

    return run


def scatter_of(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and the scatter ``n * sum(z z') - s s'`` of distinct vectors, exactly. The offset cancels."""
    rows = fit.mapInArrow(partial_sums(dim), "i int, j int, digit int, value long").groupBy("i", "j", "digit").agg(F.sum("value").alias("value"))
    got: dict[tuple[int, int], int] = {}
    for r in rows.collect():  # some digits for each of dim * (dim + 3) / 2 + 1 sums
        got[r["i"], r["j"]] = got.get((r["i"], r["j"]), 0) + (r["value"] << DIGIT * r["digit"])
    n, sums = got.get((-1, -1), 0), [got.get((i, -1), 0) for i in range(dim)]
    return n, sums, [[n * got.get((max(i, j), min(i, j)), 0) - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first. Primes are dealt to tasks."""
    moduli = enough_primes(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            flat = [polynomial_mod(matrix, moduli[k]) for k in at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(np.concatenate(flat), [len(x) for x in flat])], names=["id", "residues"])

    tasks = max(1, min(len(moduli) // 4, spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(moduli), 1, tasks).mapInArrow(run, "id long, residues array<long>").collect()
    by_prime = {r["id"]: r["residues"] for r in rows}
    return remaindered([by_prime[k] for k in range(len(moduli))], moduli)


@dataclass
class Whitening:
    """What whitening needs of a fit: count and sums of the distinct vectors (without the offset), components (one a row), roots of the scatter and its trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    roots: np.ndarray
    shares: np.ndarray

    def moved(self, z: np.ndarray) -> np.ndarray:
        """``n * x - S`` of vectors, exactly."""
        most = max([int(np.abs(z).max(initial=0)), *map(abs, self.sums), 1])
        if (self.n + 1) * most < 2**62:
            return self.n * z - np.array(self.sums, np.int64)
        return self.n * z.astype(object) - np.array(self.sums, object)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return self.moved(z).astype(np.float64) @ (self.components / np.sqrt(self.roots)[:, None]).T

    def deviations(self, z: np.ndarray) -> pa.Array:
        """Sum of ``(n * x - S) ** 2`` over the dimensions; null beyond 38 digits."""
        d = self.moved(z)
        if d.dtype != object and z.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        from decimal import Decimal

        d = d.astype(object)
        return pa.array([Decimal(x) if x < 10**38 else None for x in (d * d).sum(1)], pa.decimal128(38, 0))


def fitted(spark: SparkSession, fit: DataFrame, dim: int, most: int) -> Whitening:
    n, sums, scatter = scatter_of(fit, dim)
    roots: list[Root] = largest_roots(characteristic_polynomial(spark, scatter), most) if n > 1 else []
    trace = sum(scatter[i][i] for i in range(dim))
    values, shares, vectors = [], [], []
    for r in roots:
        twice = r.low + r.high  # of the middle, in units of 2 ** -(bits + 1)
        values += [twice / (2 << r.bits)] * r.times
        shares += [twice / (trace * (2 << r.bits))] * r.times
        vectors.append(vectors_of(scatter, r))
    components = np.vstack(vectors)[:most] if vectors else np.empty((0, dim))
    return Whitening(n, sums, components, np.array(values[:most]), np.array(shares[:most]))


def identity_error(fit: DataFrame, model: Whitening, dim: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over all its vectors."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            column = batch.column("packed")
            for start in range(0, len(column), ROWS):
                y = model.whitened(unpacked(column.slice(start, ROWS).to_pylist(), dim))
                sums += y.sum(0)
                squares += y.T @ y
        i, j = np.indices((k, k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(np.hstack([squares, sums[:, None]]).ravel())], names=["i", "j", "value"])

    if not k:
        return 0.0
    got = np.zeros((k, k + 1))
    for r in fit.mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        got[r["i"], r["j"]] = r["value"]
    mean = got[:, k] / model.n
    return float(np.abs(got[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for every usable vector and each of up to ``most`` components.

    An entry ``c`` becomes ``x = floor(64 * c) + 1000000``; beyond 2 ** 62 it is taken as that. ``n`` counts the distinct ``x`` vectors, which are the fit list:
    copies, however many, count once. ``deviation`` is a decimal, null beyond 38 digits. Components with an eigenvalue of zero do not exist, so fewer than ``most``
    (or none, where all vectors are equal) may come out; equal eigenvalues have any components at right angles that span the same space.

    Vectors that are null or empty or hold null or non-finite entries are left out. All others should have one length; where they do not, the commonest
    length among distinct vectors counts (of several, the longest), and vectors of other lengths are left out. Repeated rows each get their rows; a null key stays null; other columns are not
    read; an empty table gives no row.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(quantised, f"key {kind}, dim int, packed binary")
    fit = written(rows.select("dim", "packed").distinct(), "fit")
    lengths = fit.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0
    fit = fit.where(F.col("dim") == dim)
    model = fitted(spark, fit, dim, most)
    error = identity_error(fit, model, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, z in whole_entries(batch.column("vector")):
                if z.shape[1] == dim and len(at):
                    y = model.whitened(z)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(at)), model.deviations(z), lists(y.ravel(), [y.shape[1]] * len(y))], names=["key", "deviation", "y"])

    out = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(run, f"key {kind}, deviation decimal(38,0), y array<double>")
    shares = F.array(*[F.lit(float(x)) for x in model.shares]) if len(model.shares) else F.array().cast("array<double>")
    return out.select("key", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
