"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import stored


def _stars(edges: DataFrame) -> bool:
    """Whether each node is either the least of its component or has one link, to that least one."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node reaches; only nodes with links. Steps end when all are stars.

    Each step aggregates before it joins and is written to the shared folder; no node's neighbours meet in one task.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        # Large star: larger neighbours of u move to the least one of u and its neighbours.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("u"), F.col("m").alias("v")).unionAll(moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = stored(small, "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components once more links (a, b) are added: only those components that the links join are looked at."""
    sides = [groups.select(F.col("node").alias(c), F.col("component").alias("c" + c)) for c in "ab"]
    ends = links.join(sides[0], "a", "left").join(sides[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(ends)
    moved = groups.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(moved.unionAll(over.join(groups, "node", "left_anti").select("node", "component")), "components")
