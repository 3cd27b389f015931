"""Connected components of a link table, by rounds of smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of links (a, b: long). A node without a link is not returned.

    A round links each node to the smallest among its neighbours and itself, first for the larger neighbours of a node,
    then for the smaller ones; stars of smallest nodes remain. Rounds grow with the logarithm of a component's width.
    Each round is written to the shared folder, so lineage stays short. Joins are merges: the tables grow with the input.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: every larger neighbour of a node is linked to the least of the node and its neighbours.
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        large = edges.join(least.withColumnRenamed("a", "b").hint("merge"), "b", "left").select("a", F.coalesce("least", "b").alias("b")).distinct()
        large = written(large, "large")
        # Small star: every smaller neighbour of a node, and the node, are linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        small = written(small.where("a != b").distinct(), "links")
        signature = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))]
        same = small.agg(*signature).first() == edges.agg(*signature).first()
        discard(large, edges)
        edges = small
        if same:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
