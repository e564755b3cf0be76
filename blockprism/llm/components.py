"""Connected components of a graph that only ever is a table.

Alternating large-star and small-star steps: every node's edges are turned
towards its smallest neighbour until each component is a star around its smallest
node.  Minima are combined before the shuffle, edges of a hub are split by
``lookup``, each round is written to the shared folder, and only a count and a
checksum per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprism.llm.common import Scratch, lookup


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``(node, root)`` for every node that has an edge ``(a, b)`` to another; the root is its component's smallest."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{tag}0")
    seen, k = _state(now), 0
    while seen[0]:
        k += 1
        large = _large_star(now, scratch, f"{tag}{k}")
        after = scratch.write(_small_star(large, scratch, f"{tag}{k}"), f"{tag}{k}")
        scratch.drop(f"{tag}{k - 1}", *(f"{tag}{k}{x}" for x in ("_lm", "_sm", "_l")))
        now, last, seen = after, seen, _state(after)
        if seen == last:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{tag}_lm")
    return scratch.write(lookup(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{tag}_l")


def _small_star(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    least = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")), f"{tag}_sm")
    rest = lookup(edges, least, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
