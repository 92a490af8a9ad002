"""Connected components of a graph of any size: alternating large-star and small-star steps.

Each step replaces a node's edges by edges to the smallest node it knows.  It is a group-by
minimum (summed before the shuffle, so a hub costs no more than others) and a join that AQE splits
where a hub is hot.  Edges are checkpointed in the shared folder after each round; none reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

EDGES = 1024  # edges in a file of a round's checkpoint, about: where Hadoop has no native library, each file and its checksum start a process


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): node and component, the smallest node that it is connected with.

    Loops and repeated edges do no harm; nodes without an edge to another one are left out.  Nulls are not nodes.
    """
    c.shared_dir(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    with c.gathered(edges) as few:
        edges = few.checkpoint()
    files = max(1, -(-edges.count() // EDGES))  # a round never has more edges than the one before
    while True:
        # Done when every edge leads to a root: no node is at both ends, and no node has two edges.
        loose = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi").select("a").unionByName(edges.groupBy("a").count().where("count > 1").select("a"))
        if loose.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = _star(_star(edges, True), False).coalesce(files).checkpoint()
