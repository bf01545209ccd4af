"""Joins and running values over an order, without a task that holds a whole key.

*Intervals.* Every interval of whole numbers is the union of few dyadic ones, whose length is a power of two and whose start is a multiple of it; every point lies in
one dyadic interval of each length. So points meet intervals by equality on key, length and place, a join that Spark hashes and splits like any
other, also where one key holds most rows.

*Running values.* Rows are cut into ranges of the whole order; what a range hands on is one row for each of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

ROWS = 1_000_000  # rows of a range


def whole(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def dyadic(start: Column, end: Column, levels: int) -> Column:
    """The dyadic intervals that make up ``[start, end)``: at most two of each length, as ``struct(level, place)``."""

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("bigint")
        first, last = whole(start + size - 1, size), whole(end, size)  # whole pieces of this length inside
        # a piece is taken unless it and its neighbour make up a longer one that lies inside as well
        low = F.when((first < last) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("place")))
        high = F.when((first < last) & (last % 2 == 1), F.struct(level.alias("level"), (last - 1).alias("place")))
        return F.array(low, high)

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))
    return F.array_distinct(F.filter(pieces, lambda p: p.isNotNull()))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, *, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """All pairs of a point and an interval of its key with ``start <= at < end`` (whole numbers; a null end is open).

    Columns of both sides, the key once. Empty intervals and nulls meet nothing. The number of lengths follows from the largest point: one number on the driver.
    """
    highest, lowest = points.agg(F.max(at), F.min(at)).first()
    if highest is None:
        highest = lowest = 0
    levels = int(highest - lowest + 1).bit_length()
    clip = lambda c: (F.greatest(F.lit(lowest), F.least(c, F.lit(highest + 1))) - F.lit(lowest)).cast("bigint")
    begin, stop = clip(F.col(start)), clip(F.coalesce(F.col(end), F.lit(highest + 1)))
    pieces = intervals.where(F.col(start).isNotNull()).withColumn("__piece", F.explode(dyadic(begin, stop, levels)))
    place = lambda level: F.struct(level.alias("level"), whole(F.col(at) - F.lit(lowest), F.pow(F.lit(2), level).cast("bigint")).alias("place"))
    spread = points.where(F.col(at).isNotNull()).withColumn("__piece", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), place)))
    return spread.join(pieces, [key, "__piece"]).drop("__piece")


def carried(rows: DataFrame, key: str, order: list[str], value: str, out: str, *, ranges: int | None = None) -> DataFrame:
    """Add ``out``: the last ``value`` that is not null among the rows of the key up to this one. ``order`` must be total within a key.

    Rows are written once in ranges. A row for each range and key, with the last value in it, says what comes from earlier ranges.
    """
    if ranges is None:
        ranges = max(1, -(-rows.count() // ROWS))
    cut = staged(rows.repartitionByRange(ranges, key, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    known = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__value")))
    ends = cut.groupBy("__range", key).agg(F.max(known)["__value"].alias("__last"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(ends.select("__range", key, F.last("__last", ignorenulls=True).over(earlier).alias("__before")), "borders")
    inside = Window.partitionBy("__range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(before, ["__range", key]).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "__before")).drop("__range", "__before")


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, out: str, *, ranges: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the key up to this one. ``order`` must be total within a key."""
    if ranges is None:
        ranges = max(1, -(-rows.count() // ROWS))
    cut = staged(rows.repartitionByRange(ranges, key, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("__range", key).agg(F.sum(value).alias("__sum"))
    before = staged(sums.select("__range", key, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before")), "borders")
    inside = Window.partitionBy("__range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(before, ["__range", key]).withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__range", "__before")
