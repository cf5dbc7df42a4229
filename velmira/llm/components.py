"""Connected components by concurrent frontier breadth-first search.

Adjacency rows are hash-partitioned by node.  Every node whose hash is least among its neighbours is a seed; all
seeds expand their frontiers at once, one hop a round, until nothing new is reached.  Where the territories of
two seeds touch they collide; the collisions are the edges of a much smaller graph of seeds, which is solved the
same way, level by level.  A level keeps at most half of its nodes as seeds, so the number of levels is
logarithmic; adjacency stays in rows (a hub's neighbours are never gathered), and each round cuts its lineage with
a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velmira.session import cut


def _symmetric(edges: DataFrame) -> DataFrame:
    one = edges.where("src <> dst").select("src", "dst")
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _territories(both: DataFrame) -> DataFrame:
    """``node, seed``: every node of the graph with a seed of its component that reached it first."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    least = both.groupBy("src").agg(F.min(rank("dst")).alias("near"))
    visited = cut(least.where(rank("src") < F.col("near")).select(F.col("src").alias("node"), F.col("src").alias("seed")))
    frontier = visited
    while True:
        reached = (
            frontier.join(both, frontier["node"] == both["src"])
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min_by("seed", rank("seed")).alias("seed"))
        )
        frontier = cut(reached.join(visited.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


def components(edges: DataFrame) -> DataFrame:
    """``edges``: ``src BIGINT, dst BIGINT`` in any direction, repeats and loops allowed; rows with a null end are
    ignored.  Gives ``node, component``, one row per node that has an edge to another node; ``component`` is the
    smallest node of its component.  An empty table gives an empty table."""
    both = cut(_symmetric(edges.where("src is not null and dst is not null")))
    labels = None
    while not both.isEmpty():
        level = _territories(both)
        if labels is None:
            labels = level.withColumnRenamed("seed", "label")
        else:
            step = level.select(F.col("node").alias("label"), "seed")
            labels = cut(labels.join(step, "label", "left").select("node", F.coalesce("seed", "label").alias("label")))
        left = level.select(F.col("node").alias("src"), F.col("seed").alias("a"))
        right = level.select(F.col("node").alias("dst"), F.col("seed").alias("b"))
        both = cut(both.join(left, "src").join(right, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    if labels is None:
        return both.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
