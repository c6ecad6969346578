"""Connected components of a graph that lies in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import drop_path, new_path


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node that it reaches), for all nodes of edges: alternating large and small stars, each round written.

    A round hooks each node's neighbours to the smallest of them; sums are made map-side, and joins may be split where a
    node has very many neighbours. The number of rounds grows with the logarithm of the longest path. Whether a round has
    changed anything is seen while its pairs are written, so a round is one query. Edges need not be written.
    """
    spark, kind = edges.sparkSession, edges.schema[a].dataType.simpleString()

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path, seen = new_path(spark, "stars"), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).write.parquet(path)
        return spark.read.schema(f"u {kind}, v {kind}").parquet(path), path, (seen.get["n"], seen.get["sum"])

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs: u > v."""
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    pairs, path, last = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while last[0]:
        new, new_at, now = written(star(star(pairs, True), False))
        drop_path(spark, path)
        pairs, path = new, new_at
        if now == last:
            break
        last = now
    labels = pairs.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
