"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import hot_keys, lookup, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) with u > v. Large: every greater neighbour of a node links to the least of the node and its
    neighbours. Small: the node and its smaller neighbours link to the least of these."""
    if large:
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = links
    least = stage(ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count("*").alias("n")), "least")
    hot = hot_keys(least, "u", "n")
    joined = lookup(ends, "u", least.select("u", "least"), hot, "v")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the root is the least node that it is linked to by any path.

    Every step is staged; nothing but counts and a checksum reaches the driver.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stage(links.select(high.alias("u"), low.alias("v")).filter("u != v").distinct(), "links")

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(now)
    while before[0]:
        now = stage(_star(stage(_star(now, True), "large"), False), "small")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
