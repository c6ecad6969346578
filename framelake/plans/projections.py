"""P1-P13: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..registry import query
from ..sources.annotations import clean_shapes, normalised
from .base import BOXES, RUNS, boxes, runs, table

EDGES = "CASE WHEN {0} >= 128 THEN 128 WHEN {0} >= 96 THEN 96 WHEN {0} >= 64 THEN 64 WHEN {0} >= 32 THEN 32 WHEN {0} >= 16 THEN 16 WHEN {0} >= 0 THEN 0 END"


@query("p1_bbox_of_points", f"WITH {BOXES} SELECT frame, pos, x1, y1, x2, y2 FROM boxes")
def p1(spark, sf_dir):
    b = boxes(spark, sf_dir)
    p = lambda x, y: F.array(F.col(x), F.col(y))
    return b.select("frame", "pos", F.array(p("x2", "y1"), p("x1", "y1"), p("x1", "y2"), p("x2", "y2")).alias("points")).select("frame", "pos", *bx.bbox(F.col("points")))


@query("p2_xywh_to_xyxy", f"WITH {BOXES} SELECT frame, pos, x1, y1, x2, y2 FROM boxes")
def p2(spark, sf_dir):
    return boxes(spark, sf_dir).select("frame", "pos", F.array("x1", "y1", bx.width(), bx.height()).alias("b")).select("frame", "pos", *bx.corners(F.col("b")))


@query("p3_sides_and_area", f"WITH {BOXES} SELECT frame, pos, least(x2 - x1, y2 - y1) AS side_min, greatest(x2 - x1, y2 - y1) AS side_max, (x2 - x1) * (y2 - y1) AS area FROM boxes")
def p3(spark, sf_dir):
    return boxes(spark, sf_dir).select("frame", "pos", bx.side_min().alias("side_min"), bx.side_max().alias("side_max"), bx.area().alias("area"))


@query("p4_score_threshold", f"WITH {BOXES} SELECT frame, pos, score FROM boxes WHERE NOT is_truth AND score >= 0.05")
def p4(spark, sf_dir):
    return boxes(spark, sf_dir).where(~F.col("is_truth") & (F.col("score") >= 0.05)).select("frame", "pos", "score")


@query("p5_valid_rows", "SELECT event_id, user_id FROM events WHERE value IS NOT NULL AND value > 10 AND event_type <> 'error'")
def p5(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null and value > 10 and event_type <> 'error'").select("event_id", "user_id")


@query("p6_prefix_and_exclusion", "SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1') OR (starts_with(o_orderpriority, '2') AND NOT contains(o_orderstatus, 'P'))")
def p6(spark, sf_dir):
    o = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").where(o.startswith("1") | (o.startswith("2") & ~F.col("o_orderstatus").contains("P"))).select("o_orderkey", "o_orderpriority")


@query("p7_half_open_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def p7(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey >= 100 and o_orderkey < 1100").select("o_orderkey", "o_totalprice")


@query("p8_size_bins", f"WITH {BOXES} SELECT bin, count(*) AS n FROM (SELECT {EDGES.format('least(x2 - x1, y2 - y1) - 3')} AS bin FROM boxes) WHERE bin IS NOT NULL GROUP BY bin")
def p8(spark, sf_dir):
    return boxes(spark, sf_dir).select(bx.size_bin(bx.side_min() - 3).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("p9_search_bucket", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 5 THEN 1 ELSE 0 END AS bucket FROM part")
def p9(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bx.bucket(F.col("p_size"), [5, 20, 40]).alias("bucket"))


@query("p10_first_best", f"WITH {RUNS} SELECT item, choice, round(confidence, 9) AS confidence FROM runs")
def p10(spark, sf_dir):
    return runs(spark, sf_dir).select("item", bx.first_best(F.col("probs")).alias("choice"), F.round(F.array_max("probs"), 9).alias("confidence"))


@query("p11_expected_set", f"WITH {RUNS} SELECT item, CASE WHEN truth = 0 THEN choice IN (0, 2) ELSE choice IN (1, 3) END AS expected FROM runs")
def p11(spark, sf_dir):
    allowed = F.create_map(F.lit(0), F.array(F.lit(0), F.lit(2)), F.lit(1), F.array(F.lit(1), F.lit(3)))
    return runs(spark, sf_dir).select("item", F.array_contains(allowed[F.col("truth")], F.col("choice")).alias("expected"))


@query("p12_modulo_split", "SELECT part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'holdout' ELSE 'tune' END AS part FROM orders) GROUP BY part")
def p12(spark, sf_dir):
    part = F.when(F.col("o_orderkey") % 3 == 0, "holdout").otherwise("tune")
    return table(spark, sf_dir, "orders").select("o_orderkey", part.alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("p13_label_map", "SELECT event_id, CASE lower(trim(event_type)) WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy' END AS label FROM events")
def p13(spark, sf_dir):
    return normalised(table(spark, sf_dir, "events"), "event_type", {"click": "press", "view": "look", "purchase": "buy"}).select("event_id", "label")


@query(
    "s12_clean_shapes",
    f"""WITH {BOXES}, c AS (SELECT frame, pos, score, label AS raw, greatest(0.0, x1 - 20) AS x1, greatest(0.0, y1 - 20) AS y1, least(120.0, x2 - 20) AS x2, least(90.0, y2 - 20) AS y2 FROM boxes)
SELECT frame, pos, CASE raw WHEN 'L0' THEN 'zero' WHEN 'L1' THEN 'one' ELSE lower(raw) END AS label, x1, y1, x2, y2, score < 0.03 AS uncertain FROM c WHERE x2 - x1 >= 1 AND y2 - y1 >= 1""",
)
def s12(spark, sf_dir):
    p = lambda x, y: F.array(F.col(x) - 20, F.col(y) - 20)
    b = boxes(spark, sf_dir).select("frame", "pos", "score", "label", F.array(p("x1", "y1"), p("x2", "y2")).alias("points"), F.lit(120).alias("width"), F.lit(90).alias("height"))
    return clean_shapes(b, {"l0": "zero", "l1": "one"}, "unknown", 0.03).select("frame", "pos", "label", "x1", "y1", "x2", "y2", "uncertain")
