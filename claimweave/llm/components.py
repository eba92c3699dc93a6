"""Connected components by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of links (a, b); nodes are longs."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges)
    for _ in range(rounds):
        roots = edges.select(F.col("b").alias("a")).distinct()
        n, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if n == nodes and edges.join(roots, "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
        # large star: every larger neighbour is tied to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
