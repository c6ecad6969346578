"""Connected components of an edge table, of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: for every node of the edges the least node that it reaches. Nodes may be of any type that has an order, structs too.

    Every pass hangs each node's neighbours, and itself, on the least of them, first those above it and then those below, and
    is written; the longest path shrinks by a constant factor a pass. Minima are taken map-side, so a node with very many
    neighbours is no burden to a task. Edges that join a node to itself make it a component.
    """
    alone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    hung = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("up"), F.least(a, b).alias("down")).distinct(), "edges")
    before = None
    while (now := _print(hung)) != before:
        before = now
        hung = written(_below(_above(hung)), "edges")
    labels = hung.select(F.col("up").alias("node"), F.col("down").alias("label"))
    out = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    return out.unionByName(alone.join(out, "node", "left_anti").select("node", F.col("node").alias("label")))


def _print(hung: DataFrame) -> tuple:
    """Tells whether a pass changed anything."""
    return tuple(hung.agg(F.count(F.lit(1)), F.sum(F.xxhash64("up", "down").cast("decimal(38,0)"))).first())


def _above(hung: DataFrame) -> DataFrame:
    """Neighbours above a node hang on the least of it and its neighbours."""
    both = hung.select("up", "down").union(hung.select("down", "up"))
    least = both.groupBy("up").agg(F.min("down").alias("m")).select("up", F.least("up", "m").alias("m"))
    return both.join(least, "up").where(F.col("down") > F.col("up")).select(F.col("down").alias("up"), F.col("m").alias("down")).distinct()


def _below(hung: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node, hang on the least of them."""
    least = hung.groupBy("up").agg(F.min("down").alias("m"))
    moved = hung.join(least, "up").select(F.col("down").alias("up"), F.col("m").alias("down"))
    return moved.union(least).where(F.col("up") > F.col("down")).distinct()
