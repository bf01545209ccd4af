"""Mixing sources to target weights: a token budget handed down a tree of domains, languages and sources.

A node's budget goes to its children by weight. A child whose documents cannot fill its share, even read ``epochs`` times, takes what it can;
its siblings take the rest by weight, and only what all of them cannot take moves to the branches above. Each leaf then reads its documents in the
order of a seeded draw, epoch after epoch, until its budget is used: whole epochs first, then a prefix of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PLAIN, written

#: Slices of a leaf's draw. Only the slice in which the budget ends is sorted.
SLICES = 4096
MISSING = "(none)"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PLAIN)), F.lit(0)).cast("long")


def levels_of(docs: DataFrame, levels: list[Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(MISSING)).alias(f"level{i}") for i, c in enumerate(levels)]


def handed_down(capacity: DataFrame, depth: int, budget, weights: DataFrame | None) -> DataFrame:
    """``level0.., tokens, budget`` of every leaf, from ``level0.., tokens, capacity``. Whole numbers throughout: shares add up exactly.

    Children are filled in the order of capacity per weight, so those that stay below their share come first.
    """
    names = [f"level{i}" for i in range(depth)]
    usable = capacity
    for i in range(depth):
        here = names[:i + 1]
        if weights is None:
            usable = usable.withColumn(f"weight{i}", F.lit(1).cast("long"))
        else:
            known = weights.where(F.size("path") == i + 1).groupBy("path").agg(F.max("weight").cast("long").alias(f"weight{i}"))
            usable = (usable.withColumn("path", F.array(*here)).join(known, "path", "left").drop("path")
                      .withColumn(f"weight{i}", F.coalesce(f"weight{i}", F.lit(1).cast("long"))))
    for i in range(depth):  # nothing below a node without weight can be used
        usable = usable.withColumn("capacity", F.when(F.col(f"weight{i}") > 0, F.col("capacity")).otherwise(0))
    usable = written(usable, "capacity")
    whole = "decimal(38,0)"
    parents = None
    for i in range(depth):
        above, here = names[:i], names[:i + 1]
        nodes = usable.groupBy(*here, f"weight{i}").agg(F.sum("capacity").cast("long").alias("most")).withColumnRenamed(f"weight{i}", "weight").where("most > 0")
        nodes = nodes.join(parents, above) if above else nodes.withColumn(
            "given", F.least(F.lit(budget), F.sum("most").over(Window.partitionBy())).cast("long"))  # a row for each domain
        order = Window.partitionBy(*above).orderBy((F.col("most") / F.col("weight")).cast("double"), names[i])
        all_of = Window.partitionBy(*above)
        ranked = (nodes.withColumn("full", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(whole))
                  .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(whole))
                  .withColumn("filled", F.col("most").cast(whole) * F.col("open").cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * (F.col("given") - F.col("full"))))
        shared = (ranked.withColumn("rest", F.col("given") - F.coalesce(F.sum(F.when(F.col("filled"), F.col("most"))).over(all_of), F.lit(0)))
                  .withColumn("open", F.sum(F.when(~F.col("filled"), F.col("weight"))).over(all_of))
                  .withColumn("part", F.when(F.col("filled"), F.col("most")).otherwise(
                      F.call_function("div", F.col("weight").cast("decimal(18,0)") * F.col("rest").cast("decimal(18,0)"), F.col("open"))))
                  .withColumn("over", F.col("rest") - F.sum(F.when(~F.col("filled"), F.col("part"))).over(all_of))
                  .withColumn("turn", F.row_number().over(Window.partitionBy(*above, "filled").orderBy(names[i])))
                  .withColumn("given", F.col("part") + F.when(~F.col("filled") & (F.col("turn") <= F.col("over")), 1).otherwise(0)))
        parents = shared.select(*here, F.col("given").cast("long").alias("given"))
    return usable.select(*names, "tokens").join(parents, names, "left").select(*names, "tokens", F.coalesce("given", F.lit(0)).cast("long").alias("budget"))


def drawn(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in the draw of an epoch: 32 hexadecimal digits, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key))


def named(key: str, text: str) -> Column:
    """What a row is drawn by: its key, or its text where it has none, so that rows without a key have places of their own."""
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.concat(F.lit("without key "), F.xxhash64(F.col(f"`{text}`")).cast("string")))


def mixed(docs: DataFrame, levels: list[Column], budget: int | None = None, share: tuple[int, int] = (1, 2), weights: DataFrame | None = None,
          epochs: int = 1, seed: int = 0, key: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """All rows and columns with ``leaf_budget, n_tokens, full_epochs, part_tokens``: how often a leaf reads the document whole, and how many of its tokens the
    last epoch takes (the prefix ends inside at most one document of a leaf).

    ``levels`` are the columns of the tree from the top; a null is a branch named ``(none)``. ``budget`` counts tokens, else it is ``share`` of all. ``weights`` has
    ``path array<string>, weight``; nodes without one weigh 1, with weight 0 they and all below are left out. ``tokens`` counts the tokens of a
    row (default: words between ASCII white space). Null and empty texts have no tokens and are never taken. Rows of equal keys follow each other
    in the draw, in the order of their tokens and text; rows without a key are drawn by their text. An empty table gives no row. The four new names replace columns of the same names.
    """
    count = word_count(text) if tokens is None else tokens
    depth, names = len(levels), [f"level{i}" for i in range(len(levels))]
    narrow = written(docs.select(named(key, text).alias("by"), count.alias("tokens"), *levels_of(docs, levels)), "narrow")
    capacity = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * epochs)
    if budget is None:
        budget = (narrow.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * share[0]) // share[1]
    leaves = handed_down(capacity, depth, budget, weights).select(
        *names, "budget", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("passes"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"))
    leaves = written(leaves, "leaves")

    def sliced(rows: DataFrame, by: Column) -> DataFrame:
        return rows.withColumn("__drawn", drawn(seed, F.col("passes"), by)).withColumn("__slice", F.conv(F.substring("__drawn", 1, 3), 16, 10).cast("int"))

    sums = sliced(narrow.join(leaves, names), F.col("by")).groupBy(*names, "rest", "__slice").agg(F.sum("tokens").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy(*names).orderBy("__slice"))
    # the slice in which the budget of a leaf ends, and the tokens before it; none where nothing is left to take
    ends = sums.withColumn("upto", upto).where("upto > rest").groupBy(*names).agg(
        F.min(F.struct(F.col("__slice").alias("slice"), (F.col("upto") - F.col("sum")).alias("before"))).alias("end"))
    leaves = written(leaves.join(ends, names, "left").select(
        *names, "budget", "passes", "rest", F.coalesce("end.slice", F.lit(SLICES)).alias("last"), F.coalesce("end.before", F.lit(0)).alias("before")), "ends")

    added = ("leaf_budget", "n_tokens", "full_epochs", "part_tokens")
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), count.alias("__tokens"), named(key, text).alias("__by"), *levels_of(docs, levels))
    placed = sliced(whole.join(leaves, names), F.col("__by"))
    order = Window.partitionBy(*names).orderBy("__drawn", F.col(f"row.`{key}`"), "__tokens", F.xxhash64(f"row.`{text}`"))
    start = F.col("before") + F.coalesce(F.sum("__tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_end = placed.where(F.col("__slice") == F.col("last")).withColumn("__start", start).withColumn(
        "part", F.greatest(F.lit(0).cast("long"), F.least(F.col("__tokens"), F.col("rest") - F.col("__start"))))
    others = placed.where(F.col("__slice") != F.col("last")).withColumn("part", F.when(F.col("__slice") < F.col("last"), F.col("__tokens")).otherwise(0))
    shown = [*columns, F.col("budget").alias("leaf_budget"), F.col("__tokens").alias("n_tokens"), F.col("passes").cast("long").alias("full_epochs"),
             F.col("part").cast("long").alias("part_tokens")]
    return others.select(*shown).union(at_end.select(*shown))


def taken(mixture: DataFrame) -> DataFrame:
    """Documents that the mixture reads at least in part, once each, whole, with their own columns."""
    return mixture.where("n_tokens > 0 AND (full_epochs > 0 OR part_tokens > 0)").drop("leaf_budget", "n_tokens", "full_epochs", "part_tokens")
