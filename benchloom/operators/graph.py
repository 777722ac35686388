"""Concept taxonomy as vertex and edge tables (child, parent)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_dirs: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session, or one of its own where none is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="benchloom-core-")))
    return df.checkpoint(eager=True)


def walk(start: DataFrame, e: DataFrame) -> DataFrame:
    """(node, ancestor, depth) from pairs (node, ancestor) upwards over ``e`` (child, parent), shortest depth, the start at 0.

    Frontier by frontier until none is new: each round joins only the pairs found last and drops those of
    earlier frontiers, so a pair is expanded and written once however many paths lead to it, and cycles end.
    """
    frontiers = [cut_lineage(start.select("node", "ancestor", F.lit(0).alias("depth")))]
    while True:
        last = frontiers[-1]
        step = last.join(e, last.ancestor == e.child).select("node", F.col("parent").alias("ancestor")).distinct()
        for known in frontiers:
            step = step.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        new = cut_lineage(step.withColumn("depth", F.lit(len(frontiers))))
        if new.isEmpty():
            break
        frontiers.append(new)
    out = frontiers[0]
    for f in frontiers[1:]:
        out = out.unionByName(f)
    return out


def links(edges: DataFrame) -> DataFrame:
    return edges.select("child", "parent").where("child is not null and parent is not null").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) with the shortest depth, itself at 0."""
    e = cut_lineage(links(edges))
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    return walk(nodes.select("node", F.col("node").alias("ancestor")), e)


def descendants(edges: DataFrame, root: str) -> DataFrame:
    """(node): everything below a root, and the root; walks down from the root only. Empty for a root without edges."""
    e = links(edges)
    there = e.where((F.col("child") == root) | (F.col("parent") == root)).select(F.lit(root).alias("node"), F.lit(root).alias("ancestor")).distinct()
    down = walk(there, cut_lineage(e.select(F.col("parent").alias("child"), F.col("child").alias("parent"))))
    return down.select(F.col("ancestor").alias("node"))


def leaves(edges: DataFrame) -> DataFrame:
    """(node): children without children of their own."""
    e = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    return e.select(F.col("child").alias("node")).distinct().join(e.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def neighbors(edges: DataFrame) -> DataFrame:
    """(node, neighbor, relation): parents, children, and siblings that are neither nor the node itself."""
    e = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    up = e.select(F.col("child").alias("node"), F.col("parent").alias("neighbor"))
    down = e.select(F.col("parent").alias("node"), F.col("child").alias("neighbor"))
    a, b = e.alias("a"), e.alias("b")
    side = a.join(b, F.col("a.parent") == F.col("b.parent")).where(F.col("a.child") != F.col("b.child")).select(F.col("a.child").alias("node"), F.col("b.child").alias("neighbor")).distinct()
    side = side.join(up.unionByName(down), ["node", "neighbor"], "left_anti")
    tag = lambda d, r: d.withColumn("relation", F.lit(r))
    return tag(up, "parent").unionByName(tag(down, "child")).unionByName(tag(side, "sibling"))


def neighbor_relations(edges: DataFrame) -> DataFrame:
    """(node, neighbor, relation): one relation per pair, parent before child before sibling."""
    rank = F.when(F.col("relation") == "parent", 0).when(F.col("relation") == "child", 1).otherwise(2)
    w = Window.partitionBy("node", "neighbor").orderBy("_r")
    return neighbors(edges).withColumn("_r", rank).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_r", "_n")


def resolve_alternatives(edges: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Edges with alternative identifiers (alt, node) replaced by the primary one; loops that arise are dropped."""
    alt = alternatives.select("alt", "node").distinct()
    out = edges
    for c in ("child", "parent"):
        out = out.join(alt.withColumnRenamed("alt", c), c, "left").withColumn(c, F.coalesce("node", c)).drop("node")
    return out.where("child != parent").distinct().select("child", "parent")
