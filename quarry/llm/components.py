"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(links: DataFrame) -> bool:
    """Whether every node that points somewhere points to one node, which itself points nowhere: then no step changes a link."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long). Returns node, component (the smallest node reachable), for every linked node.

    Both steps shuffle links by node; the neighbours of a node are never gathered, only their minimum is. Each round
    is written to the shared folder. Loops and repeated links are harmless; no links give no rows.
    """
    both = links.filter("a != b")
    links = materialize(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        if _stars(links):
            break
        # large star: every larger neighbour of a node points to the smallest node of its neighbourhood; as many rows as links
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours, and the node itself, point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        links = materialize(small, "links")
    else:
        raise RuntimeError("no fixed point: raise most_rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
