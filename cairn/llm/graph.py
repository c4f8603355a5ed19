"""Connected components over edge tables, without bringing any group together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


#: Nodes with over 1 / SHARE of all edges are looked up in a broadcast table; as edges have two ends, there are at most
#: 2 * SHARE of them.
SHARE = 200
#: Edges that a task should have; tables of fewer edges lie in fewer partitions.
PER_TASK = 25_000


def up(edges: DataFrame) -> DataFrame:
    """Every edge once, from its larger end to its smaller; loops go."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def beside(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (a, b) with m of their a; ``least``: a, m, n (edges of a). The edges of a hub stay where they are."""
    hub = F.col("n") * SHARE > n_edges
    told = edges.join(F.broadcast(least.where(hub).select("a", F.col("m").alias("_m"))), "a", "left")
    others = told.where("_m is null").select("a", "b").join(least.where(~hub).select("a", "m"), "a")
    return told.where("_m is not null").select("a", "b", F.col("_m").alias("m")).unionByName(others)


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every smaller end is a root and every larger end has one edge."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``edges`` (a, b: long); comp is the component's smallest id.

    Alternates large-star and small-star steps until the edge set is a forest of stars. Each step only takes minima per
    node, combined within tasks, and rewires edges, so the largest component costs joins in proportion to its edges.
    """
    e = settle(up(edges))
    n = e.count()
    while n and not is_forest_of_stars(e):
        tasks = -(-n // PER_TASK)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = beside(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every edge of large leads down, to the minimum of a neighbourhood: the smallest is the node's new parent
        large = settle(large.coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = beside(large, least, large.count()).select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = settle(up(small.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks)).coalesce(tasks))
        n = e.count()
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
