"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import drop_written, written

#: A node with more than one in so many of all edges is heavy: there are at most twice as many heavy nodes.
HEAVY = 1000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with the value ``m`` of their ``a`` in ``least`` (a, m, n), where n counts the edges of a.

    The few heavy nodes are broadcast, so the edges of one node need no task of their own; the rest is joined by hash.
    """
    heavy = F.col("n") * HEAVY > total
    big = F.broadcast(least.where(heavy).select("a", "m"))
    small = least.where(~heavy).select("a", "m")
    return edges.join(big, "a").select("a", "b", "m").unionByName(edges.join(big, "a", "left_anti").join(small, "a").select("a", "b", "m"))


def _open_and_total(edges: DataFrame) -> tuple[bool, int]:
    """Whether some node has several lesser neighbours, or one that has one itself, and the number of edges.

    An edge leads from the greater to the lesser node; without an open node, every edge leads to the least of its component.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    found = seen.agg(F.max(F.expr("out > 1 or (out = 1 and into = 1)")).alias("open"), F.sum("out").alias("total")).first()
    return bool(found["open"]), found["total"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns ``a`` and ``b``); a component is its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every edge leads to the
    least node of its component. Each step is a pre-aggregated minimum for each node and a join back, with
    the heavy nodes broadcast; no step gathers a component anywhere. Each round
    is written to the shared folder. Self loops and null ends are left out.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        open_, total = _open_and_total(now)
        if not open_:
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # large star: greater neighbours go to the least neighbour
        large = written(_with_least(both.where("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        # small star: lesser neighbours, and the node itself, go to the least one
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = written(small.where("a <> b").distinct())
        drop_written(now)
        drop_written(large)
        now = new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
