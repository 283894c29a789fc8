"""Connected components over an edge table, as rounds of joins and minima (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import checkpointed


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root): root is the smallest node of the component.

    Every round is two minima per node (combined before the shuffle) and two
    equi-joins whose hot nodes the adaptive planner can split; the edge table is
    checkpointed after each round, and only its count and checksum reach the driver.
    Rounds grow with the logarithm of the longest chain. Nodes without edges are not listed.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpointed(e)
    before = None
    while before != (state := _state(e)):
        before = state
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that both sides of the join are plain and a hub's rows can be split
        low = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        linked = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = linked.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        e = checkpointed(small)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
