"""Stand-ins over the driver's tables: boxes, detections by frame, tracks, classification runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str, block: int | None = None) -> DataFrame:
    """frame, pos, is_truth, label, track, score, x1..y2 from lineitem; odd line numbers are truths.

    With block, frames come in blocks of so many, each in one task in the order of frames, and `block` tells the first frame of theirs: what is made of
    a block or of its frames then needs no further shuffle.
    """
    rows, keys = table(spark, sf_dir, "lineitem").withColumn("frame", F.col("l_orderkey")), ["frame"]
    if block is not None:
        rows, keys = rows.withColumn("block", F.floor(F.col("frame") / block) * block).repartition("block"), ["block", *keys]
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)) - 1
    q = F.col("l_quantity").cast("long")
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    return rows.select(
        *keys, pos.cast("long").alias("pos"), (F.col("l_linenumber") % 2 == 1).alias("is_truth"), F.concat(F.lit("L"), F.col("l_partkey") % 7).alias("label"),
        (F.col("l_partkey") % 50).alias("track"), F.col("l_discount").alias("score"), x.alias("x1"), y.alias("y1"), (x + q * 3).alias("x2"), (y + q * 7 % 120 + 2).alias("y2"),
    )


BOXES = f"""boxes AS (
  SELECT l_orderkey AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS BIGINT) AS pos,
         l_linenumber % 2 = 1 AS is_truth, 'L' || CAST(l_partkey % 7 AS VARCHAR) AS label, l_partkey % 50 AS track, l_discount AS score,
         CAST(l_partkey % 100 AS DOUBLE) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS y1,
         CAST(l_partkey % 100 + CAST(l_quantity AS BIGINT) * 3 AS DOUBLE) AS x2,
         CAST(l_suppkey % 100 + CAST(l_quantity AS BIGINT) * 7 % 120 + 2 AS DOUBLE) AS y2
  FROM lineitem)"""


def iou_sql(a: str, b: str) -> tuple[str, str]:
    """Intersection and iou of two boxes in SQL."""
    inter = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return inter, f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0 END)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, lang, source, side, truth, answer, ok, confidence, probs from documents with labels."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    p = [((F.col("doc_id") * k + F.col("n_chars")) % 97) / F.lit(97.0) for k in (7, 13, 29, 31)]
    rows = d.join(l, "doc_id").select(F.col("doc_id").alias("item"), "lang", "source", (F.col("n_chars") % 200).cast("double").alias("side"), F.col("quality").alias("truth"), F.array(*p).alias("probs"))
    answer = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    return rows.withColumn("answer", answer % 2).withColumn("choice", answer).withColumn("ok", F.col("answer") == F.col("truth")).withColumn("confidence", F.array_max("probs"))


RUNS = """runs AS (
  SELECT item, lang, source, side, truth, probs, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS choice, (list_position(probs, list_max(probs)) - 1) % 2 AS answer,
         (list_position(probs, list_max(probs)) - 1) % 2 = truth AS ok, list_max(probs) AS confidence
  FROM (SELECT d.doc_id AS item, lang, source, CAST(n_chars % 200 AS DOUBLE) AS side, quality AS truth,
               [((d.doc_id * 7 + n_chars) % 97) / 97.0::DOUBLE, ((d.doc_id * 13 + n_chars) % 97) / 97.0::DOUBLE, ((d.doc_id * 29 + n_chars) % 97) / 97.0::DOUBLE, ((d.doc_id * 31 + n_chars) % 97) / 97.0::DOUBLE] AS probs
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""


def lattice_sql(keys: list[str], seed: int = 0) -> str:
    """sampling.lattice in SQL."""
    h = f"CAST({seed + 1} AS BIGINT)"
    for k in keys:
        h = f"(({h} * 48271 + CAST({k} AS BIGINT) * 69621 + 1) % 2147483647)"
    return f"(({h} * 48271 % 2147483647 * 69621 % 2147483647) / 2147483647.0::DOUBLE)"
