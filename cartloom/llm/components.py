"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import lookup_join, parts_for, written


def _stars(pairs: DataFrame) -> bool:
    """Whether each node hangs on one smaller node at most, and none on a node that hangs itself."""
    ends = pairs.select(F.col("high").alias("u"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(pairs.select("low", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that edges (columns ``a`` and ``b``) reach from it; for nodes that have an edge.

    Alternates two steps until every node hangs on its root: each node hands its larger neighbours to the least one around it, then its
    smaller ones and itself. The number of rounds grows with the logarithm of the longest path. No step gathers the neighbours of a node.
    """
    pairs = written(edges.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    parts = parts_for(pairs.sparkSession, pairs.count())
    while not _stars(pairs):
        # larger neighbours go to the least neighbour; low < high throughout
        both = pairs.select(F.col("high").alias("u"), F.col("low").alias("v")).union(pairs.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")).select("u", F.least("u", "m").alias("m"), "w")
        handed = lookup_join(pairs.select(F.col("low").alias("u"), F.col("high").alias("v")), least, ["u"], "w", parts=parts)
        grown = written(handed.select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low <> high").distinct(), "edges", parts)
        # smaller neighbours, and the node itself, go to the least of them
        least = grown.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"), F.count(F.lit(1)).alias("w"))
        handed = lookup_join(grown.select(F.col("high").alias("u"), F.col("low").alias("v")), least, ["u"], "w", parts=parts)
        stars = handed.select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low <> high")
        pairs = written(stars.union(least.select(F.col("m").alias("low"), F.col("u").alias("high"))).distinct(), "edges", parts)
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).union(pairs.select("low", "low")).distinct().coalesce(parts)
