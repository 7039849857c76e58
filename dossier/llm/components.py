"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges (a, b).

    Large-star and small-star in turn: each joins nodes to the least neighbour they know, which halves the depth of
    trees, so the rounds grow with the logarithm of the longest path. A node with very many neighbours is one row of
    a partial aggregate and one side of a join that is split where it is skewed. Nothing is gathered.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = written(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = written(small, "small-star")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark


def merged(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The components `found` (node, component) once the edges (a, b) are added; only the edges' components are worked on."""
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        known = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        other = "b" if end == "a" else "a"
        ends = ends.join(known, F.col(end) == F.col("_node"), "left").select(F.coalesce("_component", end).alias(end), other)
    between = components(ends).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    relabelled = found.join(between, found["component"] == between["_node"], "left").select(
        "node", F.coalesce("_component", "component").alias("component"))
    fresh = between.join(found, between["_node"] == found["node"], "left_anti").select(
        F.col("_node").alias("node"), F.col("_component").alias("component"))
    return written(relabelled.unionByName(fresh), "components")
