"""Connected components by alternating stars, with lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlens.llm import scratch

#: Edges in a file of an intermediate table.
FILE_EDGES = 500_000


def _towards_least(edges: DataFrame, files: int) -> DataFrame:
    """Edges (u, v): every v of a u, and u itself, gets an edge to the least of them all.

    The least ones are stored first, so that the join back is one between two
    plain shuffles and a u with very many edges can be split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(scratch.store(least.coalesce(files), "least"), "u").select("u", "v", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return per.where("up > 1 OR (up > 0 AND root > 0)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) whose root is another node; the root is the least of its component.

    Edges may repeat and point either way; loops and nulls are ignored.
    """
    files = max(2, edges.count() // FILE_EDGES)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.store(now.coalesce(files), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, files).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.store(large.coalesce(files), "large-star")
        small = _towards_least(large, files)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.where("u <> m").select("u", F.col("m").alias("v")))
        after = scratch.store(small.distinct().coalesce(files), "small-star")
        scratch.drop(now, large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the edges behind roots and of links (a, b), from the components' own graph."""
    ends = links.select("a", "b")
    for end in "ab":
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    above = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    own = above.select(F.col("root").alias("node"), F.col("top").alias("root"))
    return known.unionByName(own)
