"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").union(edges.select("lo", "hi")).toDF("v", "u")
    least = materialize(both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m")), "least")  # a table, so Spark can split the join's hot nodes
    return both.where("u > v").join(least, F.col("v") == F.col("w")).select(
        F.col("u").alias("hi"), F.col("m").alias("lo"),
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w"), "least")
    moved = edges.join(least, F.col("hi") == F.col("w")).where("lo <> m").select("lo", "m")
    return moved.union(least.select("w", "m")).toDF("hi", "lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one orderable type to (node, root): each node with an edge, and the smallest node reachable, itself for a root.

    Every step is a grouped minimum and a join on the node, whose large partitions Spark splits; the steps
    stop when the set of edges, which are stars then, no longer changes.
    """
    stars = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")))
    before, now = None, stars.select(mark).first()[0]
    while now != before:
        stars = materialize(_small_star(_large_star(stars)), "stars")
        before, now = now, stars.select(mark).first()[0]
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(stars.select("lo", "lo").distinct())
