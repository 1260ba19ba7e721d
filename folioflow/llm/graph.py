"""Connected components over edge tables, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node that it reaches.

    Nodes are longs. Rows with a null end are left out; an empty table gives an empty one. Each round is
    partial minima and a join on the node, so a node with very many edges is split by Spark's skew join.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    # cut once, so that what gives the edges isn't computed again for the nodes
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = e.where("a <> b")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).where("a <> b").union(low.select("a", "m")).distinct()
        e, old = cut(small), mark
        mark = _mark(e)
        if mark == old:
            break
    roots = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
