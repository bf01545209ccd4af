"""Jump consistent hashing: rows to shards by key, without a table of the ring.

A key walks a sequence of jumps that depends on the key alone; with ``n`` shards it stays at the last jump below ``n``. So one more
shard takes exactly the rows whose next jump is that shard, and no other row moves.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

# fixed values of the published generator
MULTIPLIER = Decimal(2862933555777941757)
WORD = Decimal(2**64)


def jumps(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the shard of a BIGINT key among ``shards`` and among ``shards + 1``. A null key counts as 0.

    The state is kept in DECIMAL(38), which holds the product of two 64-bit numbers.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    whole = F.coalesce(key.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    start = F.struct(
        F.when(whole < 0, whole + F.lit(WORD)).otherwise(whole).cast("decimal(20,0)").alias("state"),
        F.lit(0).cast("long").alias("next"), F.lit(0).alias("shard"), F.lit(0).alias("grown"))

    def step(a: Column, _: Column) -> Column:
        state = ((a["state"] * F.lit(MULTIPLIER)).cast("decimal(38,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(WORD)
        # the upper 31 bits set how far the key jumps
        state = state.cast("decimal(20,0)")
        high = F.floor(state / F.lit(2**33).cast("decimal(10,0)")).cast("long")
        ahead = F.floor((a["next"] + 1).cast("double") * (F.lit(float(2**31)) / (high + 1).cast("double"))).cast("long")
        return F.when(a["next"] > shards, a).otherwise(F.struct(
            state.alias("state"), ahead.alias("next"),
            F.when(a["next"] < shards, a["next"].cast("int")).otherwise(a["shard"]).alias("shard"),
            a["next"].cast("int").alias("grown")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda a: F.struct(a["shard"].alias("shard"), a["grown"].alias("grown")))


def sharded(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_slice: int = 50_000) -> DataFrame:
    """All rows with their shard and a gapless slot in it: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the number of UTF-8 bytes plus 8 (null: 8), ``text_crc32`` that of a null text is 0, as of an empty one. Other columns are
    not read. Rows with equal keys share a shard, also null keys, and take slots in the order of their checksum and size. The slot is the
    rank by key within the shard. Ranges of rows in that order are counted by shard, and a row's rank in its range comes after the counts of the
    ranges before, so that no task sorts more than about ``rows_per_slice`` rows at a time; only rows with equal key, checksum and size stay together.
    An empty table gives no row.
    """
    slices = max(1, math.ceil(docs.count() / rows_per_slice))
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).alias(key), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    walked = jumps(F.col(key).cast("long"), shards)
    # ranges are drawn from samples: counts and ranks must see the same ones
    placed = written(rows.repartitionByRange(slices, key, "text_crc32", "size").select(
        key, "size", "text_crc32", walked.alias("jump"), F.spark_partition_id().alias("slice")).select(
        key, "size", "text_crc32", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown_shard"), "slice"), "slots")
    counted = (placed.groupBy("shard", "slice").count()
               .withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
               .select("shard", "slice", F.coalesce("before", F.lit(0)).alias("before")))
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(key, "text_crc32", "size"))
    return placed.join(counted, ["shard", "slice"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + place - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, key: str = "doc_id") -> None:
    """Write whole rows under ``shard=<n>`` folders; a row's folder depends on its key and ``shards`` alone."""
    docs.withColumn("shard", jumps(F.col(key).cast("long"), shards)["shard"]).write.partitionBy("shard").parquet(path)
