"""Connected components of an edge table (alternating large and small stars) and roots of a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller, with the node itself) neighbours of every node on the least."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # edges point down, so all neighbours are smaller
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (a, b)."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        edges = cut(_stars(_stars(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest_roots(parents: DataFrame) -> DataFrame:
    """node and root for rows (node, parent) with one parent each and no cycle: every round a node takes
    its parent's parent, so the rounds grow with the logarithm of the depth."""
    now, before = cut(parents.select("node", F.col("parent").alias("root"))), None
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("up"))
        now = cut(now.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
        if state == before:
            return now
        before = state
