"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def told(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and hash as counted when they were written: so a round needs no jobs to count."""
    seen = Observation()
    made = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")), "star-edges")
    return made, (seen.get.get("n", 0), seen.get.get("h"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: long); root is the component's least node.

    Each round points a node's larger neighbours at its least neighbour (large star), then a node
    and its smaller neighbours at the least of them (small star), until nothing moves. Rounds grow
    with the logarithm of a component's size; every round is two aggregations and joins on the
    edges, none of which leaves the cluster.
    """
    now, rows = told(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        before, rows_before = now, rows
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now, rows = told(small.where("a <> b").distinct())
        settled = rows == rows_before and now.join(before, ["a", "b"], "left_anti").isEmpty()
        discard(before)
        if settled:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
