"""Connected components of a graph given by its edges, by alternating large-star and small-star jobs.

Each round is a grouping with partial aggregation and an equi-join whose hot keys Spark can split; no
component meets in one task. The edges of a round are stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, store


def _stars(pairs: DataFrame, least_of_all: bool) -> DataFrame:
    """pairs (u, v): link neighbours of u to the least node next to u.

    Large star: neighbours greater than u; small star: u and those less than u."""
    if least_of_all:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of an edge (a, b) with the least node of its component."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct()
    state = before = None
    while True:
        pairs, path = store(_stars(_stars(pairs, True), False), "components")
        if before:
            discard(before)  # no later job reads it
        before = path
        now = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
