"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def state(edges: DataFrame) -> tuple:
    """Tells whether two rounds have the same edges: one row."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high")), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node it is connected with.

    Each round points every node at the smallest node next to it, and the smallest nodes at each other, so that long chains halve.
    Smallest neighbours are aggregated before the shuffle; a node with very many links meets its own row in a join that
    Spark can split. Rounds end when nothing changes; each is written to the shared folder. Null ends are left out.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    edges = written(edges, "edges")
    before = state(edges)
    while True:
        # every node above its smallest neighbour: neighbours that are larger hang below the smallest
        both = edges.select(F.col("low").alias("x"), F.col("high").alias("y")).union(edges.select("high", "low"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.where("y > x").join(least, "x").select(F.col("m").alias("low"), F.col("y").alias("high"))
                 .where("low <> high").distinct())
        large = written(large, "large")
        # smaller neighbours of a node, and the node itself, hang below the smallest of them
        root = large.groupBy("high").agg(F.min("low").alias("m"))
        small = (large.join(root, "high").select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high"))
                 .where("low <> high").distinct())
        small = written(small, "small")
        after = state(small)
        if after == before:
            break
        edges, before = small, after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        edges.select("low", "low").distinct())
