"""G1-G6: tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..operators import sampling, tiles
from ..registry import query
from .base import BOXES, boxes, lattice_sql, table

SPREAD = "CASE WHEN {n} <= 64 THEN [0] ELSE list_concat(range(0, {n} - 64, 48), [{n} - 64]) END"


@query(
    "g1_snapped_starts",
    """WITH s AS (SELECT p_partkey, p_size * 20 AS n, CASE WHEN p_size * 20 >= 300 THEN (p_size * 20 - 300) // 240 + 1 ELSE 0 END AS fit FROM part)
SELECT p_partkey, unnest(list_concat(list_transform(range(fit), lambda i: i * 240), CASE WHEN n > 0 AND fit * 240 < n THEN [greatest(n - 300, 0)] ELSE [] END)) AS "start" FROM s""",
)
def g1(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tiles.snapped_starts(F.col("p_size") * 20, 300, 0.2)).alias("start"))


@query("g2_spread_starts", f"SELECT p_partkey, CAST(unnest({SPREAD.format(n='(p_size * 10)')}) AS BIGINT) AS \"start\" FROM part")
def g2(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tiles.spread_starts(F.col("p_size") * 10, 64, 0.25)).alias("start"))


@query(
    "g3_seams",
    f"""WITH s AS (SELECT p_partkey, {SPREAD.format(n='(p_size * 10)')} AS t FROM part), e AS (SELECT p_partkey, t, unnest(range(1, len(t))) AS i FROM s)
SELECT p_partkey, CAST(t[i + 1] AS BIGINT) AS "start", CAST(t[i] + 64 AS BIGINT) AS "end" FROM e""",
)
def g3(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", tiles.spread_starts(F.col("p_size") * 10, 64, 0.25).alias("t"))
    return s.select("p_partkey", F.explode(tiles.seams(F.col("t"), 64)).alias("s")).select("p_partkey", "s.start", "s.end")


TILED = f"""{BOXES}, t AS (SELECT frame, pos, x1, y1, x2, y2, tx, ty, greatest(x1, tx) AS cx1, greatest(y1, ty) AS cy1, least(x2, tx + 64) AS cx2, least(y2, ty + 64) AS cy2
  FROM boxes, (SELECT unnest({SPREAD.format(n='256')}) AS tx) a, (SELECT unnest({SPREAD.format(n='224')}) AS ty) b),
c AS (SELECT *, (cx2 - cx1) * (cy2 - cy1) / greatest((x2 - x1) * (y2 - y1), 1e-6) AS share FROM t WHERE cx2 > cx1 AND cy2 > cy1)"""


def tiled(spark, sf_dir):
    return tiles.in_tiles(boxes(spark, sf_dir), F.lit(256), F.lit(224), 64, 0.25, 0.35)


@query("g4_boxes_in_tiles", f"WITH {TILED} SELECT frame, pos, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, cx1, cy1, cx2, cy2, round(share, 9) AS share, share >= 0.35 AS kept FROM c")
def g4(spark, sf_dir):
    return tiled(spark, sf_dir).select("frame", "pos", "tx", "ty", "cx1", "cy1", "cx2", "cy2", F.round("share", 9).alias("share"), "kept")


@query("g5_normalised_boxes", f"WITH {TILED} SELECT frame, pos, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, round(((cx1 + cx2) / 2 - tx) / 64, 6) AS cx, round(((cy1 + cy2) / 2 - ty) / 64, 6) AS cy, round((cx2 - cx1) / 64, 6) AS w, round((cy2 - cy1) / 64, 6) AS h FROM c WHERE share >= 0.35")
def g5(spark, sf_dir):
    t = tiled(spark, sf_dir).where("kept").select("frame", "pos", "tx", "ty", F.col("cx1").alias("x1"), F.col("cy1").alias("y1"), F.col("cx2").alias("x2"), F.col("cy2").alias("y2"))
    c = F.col
    out = t.select("frame", "pos", "tx", "ty", *bx.yolo((c("tx"), c("ty"), c("tx") + 64, c("ty") + 64)))
    return out.withColumns({k: F.round(k, 6) for k in ("cx", "cy", "w", "h")})


@query(
    "g6_empty_tiles",
    f"""WITH {TILED}, g AS (SELECT frame, unnest({SPREAD.format(n='256')}) AS tx FROM (SELECT DISTINCT frame FROM boxes)), h AS (SELECT frame, CAST(tx AS BIGINT) AS tx, CAST(unnest({SPREAD.format(n='224')}) AS BIGINT) AS ty FROM g)
SELECT frame, tx, ty FROM h WHERE {lattice_sql(['frame', 'tx', 'ty'])} < 0.2 AND NOT EXISTS (SELECT 1 FROM c WHERE c.frame = h.frame AND c.tx = h.tx AND c.ty = h.ty AND share >= 0.35)""",
)
def g6(spark, sf_dir):
    """Empty tiles that a chance of 0.2, drawn from the tile's own key, keeps."""
    b = tiled(spark, sf_dir).where("kept").select("frame", "tx", "ty").distinct()
    grid = boxes(spark, sf_dir).select("frame").distinct().withColumn("tx", F.explode(tiles.spread_starts(256, 64, 0.25))).withColumn("ty", F.explode(tiles.spread_starts(224, 64, 0.25)))
    return grid.where(sampling.lattice(["frame", "tx", "ty"]) < 0.2).join(b, ["frame", "tx", "ty"], "left_anti")


def jittered_sql() -> str:
    noise = lambda k, side: f"({lattice_sql(['frame', 'pos'], k)} - 0.5) * 0.2 * {side}"
    cols = ", ".join(f"round({c} + {noise(k, '(x2 - x1)' if c[0] == 'x' else '(y2 - y1)')}, 6) AS {c}" for k, c in enumerate(("x1", "y1", "x2", "y2")))
    return f"WITH {BOXES} SELECT frame, pos, {cols} FROM boxes WHERE {lattice_sql(['frame', 'pos'], 9)} >= 0.2"


@query("g9_jittered_boxes", jittered_sql())
def g9(spark, sf_dir):
    """Boxes with noise from a hash of their key, one in five dropped (inputs for tests of robustness)."""
    noise = lambda seed, side: (sampling.lattice(["frame", "pos"], seed) - 0.5) * 0.2 * side
    b = boxes(spark, sf_dir).where(sampling.lattice(["frame", "pos"], 9) >= 0.2)
    w, h = bx.width(), bx.height()
    return b.select("frame", "pos", *[F.round(F.col(c) + noise(k, w if c[0] == "x" else h), 6).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])
