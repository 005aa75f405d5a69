"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) of every node of edges (a, b: long).

    Each round is two groupings; its edges are written to the shared folder.
    Neighbours of a node are never gathered: only their minimum is.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(low, "a")
        if large:
            out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        now = cut(star(star(now, True), False), "star")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most and none both up and down: each component is a star around its smallest node."""
    ends = edges.select(F.col("a").alias("node"), (F.col("a") > F.col("b")).cast("int").alias("down")).unionByName(edges.select(F.col("b").alias("node"), (F.col("b") > F.col("a")).cast("int").alias("down")))
    found = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least")).where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("least") == 0)))
    return found.isEmpty() and edges.where("a < b").isEmpty()
