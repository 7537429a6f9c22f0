"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrunner.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the neighbours above each node on the least node around it.

    The least node is an aggregate that combines before the shuffle; joining it
    back leaves a hot node to skew splitting.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the neighbours below each node, and the node itself, on the least of them."""
    below = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = below.groupBy("u").agg(F.min("v").alias("m"))
    moved = below.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node of an edge: node, component (its least reachable node).

    Ends when every node hangs on one other that hangs on nothing itself, so that
    the edges are stars around the least nodes. Self-links and repeated links
    change nothing; without links there are no rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    while True:
        now = written(_small_star(_large_star(now)).filter("u <> v").distinct())
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")) \
            .unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        loose = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if not loose.filter("hangs > 1 or (hangs = 1 and holds = 1)").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
