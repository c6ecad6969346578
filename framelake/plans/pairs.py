"""J1-J9, A1, G7, G8: pairs of boxes, matches and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..operators import matching, metrics
from ..registry import query
from ..sources.scratch import written
from .base import BOXES, boxes, iou_sql, table

INTER, IOU = iou_sql("a", "b")


@query("j1_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j1(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("j2_composite_lookup", "SELECT a.doc_id, a.lang, b.quality FROM documents a JOIN labels b ON a.doc_id = b.doc_id AND a.doc_id % 2 = b.quality")
def j2(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 2).cast("int").alias("quality")), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return a.join(b, ["doc_id", "quality"]).select("doc_id", "lang", "quality")


PAIRS = f"""WITH {BOXES}, p AS (SELECT a.frame, a.pos AS truth_pos, b.pos AS pos, {IOU} AS iou FROM boxes a JOIN boxes b ON a.frame = b.frame WHERE a.is_truth AND NOT b.is_truth)
SELECT frame, truth_pos, pos, round(iou, 9) AS iou FROM p WHERE iou > 0.1"""


@query("j3_iou_matrix", PAIRS)
def j3(spark, sf_dir):
    b = boxes(spark, sf_dir)
    pairs = matching.iou_pairs(b.where("is_truth"), b.where(~F.col("is_truth")), ["frame"], 0.1)
    return pairs.select("frame", F.col("a_pos").alias("truth_pos"), F.col("b_pos").alias("pos"), F.round("iou", 9).alias("iou"))


@query("j3_iou_matrix_in_cells", PAIRS)
def j3_cells(spark, sf_dir):
    b = boxes(spark, sf_dir)
    pairs = matching.iou_pairs_in_cells(b.where("is_truth"), b.where(~F.col("is_truth")), ["frame"], 64.0, 0.1)
    return pairs.select("frame", F.col("a_pos").alias("truth_pos"), F.col("b_pos").alias("pos"), F.round("iou", 9).alias("iou"))


def greedy_sql(least: float, source: str = "boxes", key: str = "frame") -> str:
    """CTEs up to m, which has a row for each box found in the order of scores, with the truth that it takes (or null). key: columns of a frame."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    step = " AND ".join(f"p.{k} = m.{k}" for k in key.split(", "))
    cols = lambda t: ", ".join(f"{t}.{k}" for k in key.split(", "))
    return f"""c AS (SELECT {cols('b')}, b.pos, list({{'truth': a.pos, 'iou': {IOU}}} ORDER BY {IOU} DESC, a.pos) FILTER (WHERE {IOU} >= {least} AND {IOU} > 0) AS near
  FROM {source} b LEFT JOIN {source} a ON {on} AND a.is_truth WHERE NOT b.is_truth GROUP BY {cols('b')}, b.pos),
p AS (SELECT c.*, row_number() OVER (PARTITION BY {cols('c')} ORDER BY s.score DESC, c.pos) AS r FROM c JOIN {source} s ON {" AND ".join(f"s.{k} = c.{k}" for k in key.split(", "))} AND s.pos = c.pos),
m AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS STRUCT(truth BIGINT, iou DOUBLE)) AS pick FROM {source}
  UNION ALL SELECT {key}, r, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.truth) END, pos, pick
  FROM (SELECT {cols('m')}, p.r, m.taken, p.pos, list_filter(p.near, lambda x: NOT list_contains(m.taken, x.truth))[1] AS pick FROM m JOIN p ON {step} AND p.r = m.r + 1) t)"""


BIN = "CASE WHEN least(x2 - x1, y2 - y1) >= 128 THEN 128 WHEN least(x2 - x1, y2 - y1) >= 96 THEN 96 WHEN least(x2 - x1, y2 - y1) >= 64 THEN 64 WHEN least(x2 - x1, y2 - y1) >= 32 THEN 32 WHEN least(x2 - x1, y2 - y1) >= 16 THEN 16 ELSE 0 END"


def recall_sql(source: str, key: str, by: str) -> str:
    """Recall by size bin and in all (bin -1), after greedy_sql."""
    lead = f"{by}, " if by else ""
    join = " AND ".join(f"g.{k} = h.{k}" for k in key.split(", "))
    total = f"SELECT {lead}CAST(-1 AS INTEGER) AS bin, CAST(sum(gt) AS BIGINT) AS gt, CAST(sum(hits) AS BIGINT) AS hits FROM k" + (f" GROUP BY {by}" if by else "")
    same = f" WHERE f.{by} = t.{by}" if by else ""
    return f""", g AS (SELECT {", ".join(dict.fromkeys([*key.split(", "), *(by.split(", ") if by else [])]))}, pos, {BIN} AS bin FROM {source} WHERE is_truth), h AS (SELECT {key}, pick.truth AS pos FROM m WHERE pick IS NOT NULL),
k AS (SELECT {f"g.{by} AS {by}, " if by else ""}bin, count(*) AS gt, count(h.pos) AS hits FROM g LEFT JOIN h ON {join} AND g.pos = h.pos GROUP BY ALL), t AS ({total}),
q AS (SELECT t.*, (SELECT count(*) FROM {source} f{same + " AND" if by else " WHERE"} NOT f.is_truth) AS pred, (SELECT count(*) FROM h f{same}) AS tp FROM t)
SELECT {lead}bin, gt, hits, NULL AS pred, NULL AS tp, round(hits / gt, 9) AS recall, NULL AS "precision" FROM k
UNION ALL SELECT {lead}bin, gt, hits, pred, tp, CASE WHEN gt > 0 THEN round(hits / gt, 9) ELSE 0.0 END, CASE WHEN pred > 0 THEN round(tp / pred, 9) ELSE 0.0 END FROM q"""


@query("j4_greedy_match", f"WITH RECURSIVE {BOXES}, {greedy_sql(0.3)} SELECT frame, pick.truth AS truth_pos, pos, round(pick.iou, 9) AS iou FROM m WHERE pick IS NOT NULL")
def j4(spark, sf_dir):
    return matching.match(boxes(spark, sf_dir), ["frame"], 0.3).withColumn("iou", F.round("iou", 9))


@query("j5_optimal_assignment")
def j5(spark, sf_dir):
    return matching.match(boxes(spark, sf_dir), ["frame"], 0.3, "optimal").withColumn("iou", F.round("iou", 9))


TOTALS = f"""WITH RECURSIVE {BOXES}, t AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY pos) AS i FROM boxes WHERE is_truth),
o AS (SELECT a.frame, a.i, b.pos AS f, {IOU} AS iou FROM t a JOIN boxes b ON a.frame = b.frame AND NOT b.is_truth WHERE {IOU} > 0 UNION ALL SELECT frame, i, NULL, 0.0 FROM t),
m AS (SELECT DISTINCT frame, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(0 AS DOUBLE) AS total FROM boxes
  UNION ALL SELECT m.frame, o.i, CASE WHEN o.f IS NULL THEN m.used ELSE list_append(m.used, o.f) END, m.total + o.iou FROM m JOIN o ON o.frame = m.frame AND o.i = m.i + 1 WHERE o.f IS NULL OR NOT list_contains(m.used, o.f))
SELECT frame, round(max(total), 6) AS total FROM m GROUP BY frame"""


@query("j5_assignment_totals", TOTALS)
def j5_totals(spark, sf_dir):
    """The greatest total overlap of each frame's one-to-one pairs, which is the same for all optimal assignments."""
    b = boxes(spark, sf_dir)
    total = matching.match(b, ["frame"], 0.0, "optimal").groupBy("frame").agg(F.sum("iou").alias("total"))
    return b.select("frame").distinct().join(total, "frame", "left").select("frame", F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))


@query("j5_dual_certificate", TOTALS.replace("SELECT frame, round(max(total), 6) AS total FROM m", "SELECT frame, round(max(total), 6) AS total, 0 AS too_low, 0 AS loose FROM m"))
def j5_certificate(spark, sf_dir):
    """The proof that assignments are optimal, checked here by joins: potentials add up to the best total of all assignments, for no pair to less than its overlap (too_low), and are tight (loose: pairs taken of which they aren't the overlap, boxes in none that have one)."""
    b = boxes(spark, sf_dir)
    proof = written(matching.certificate(b, ["frame"], carry=matching.BOX), "certificate")
    side = lambda truth: proof.where(F.col("is_truth") == truth).drop("is_truth", "iou")
    both, mates = F.col("a_potential") + F.col("b_potential"), F.col("a_mate") == F.col("b_pos")
    # what a frame's pairs have to do with each other is found in one join on the frame
    checked = matching.iou_pairs(side(True), side(False), ["frame"]).groupBy("frame").agg(
        F.count_if(both < F.col("iou") - 1e-9).alias("too_low"), F.count_if(mates).alias("met"), F.count_if(mates & (F.abs(both - F.col("iou")) > 1e-9)).alias("slack")
    )
    held = F.count_if((F.col("potential") < 0) | (F.col("mate").isNull() & (F.abs("potential") > 1e-9)))
    total = proof.groupBy("frame").agg(F.sum("potential").alias("total"), held.alias("held"), F.count_if(F.col("is_truth") & F.col("mate").isNotNull()).alias("taken"))
    out = total.join(checked, "frame", "left")
    loose = F.col("held") + F.coalesce("slack", F.lit(0)) + F.col("taken") - F.coalesce("met", F.lit(0))  # pairs taken that don't overlap are loose as well
    return out.select("frame", F.round("total", 6).alias("total"), F.coalesce("too_low", F.lit(0)).cast("int").alias("too_low"), loose.cast("int").alias("loose"))


@query(
    "j7_containment",
    f"""WITH {BOXES}, m AS (
  SELECT a.track AS track, b.track AS box_of, row_number() OVER (PARTITION BY a.frame, a.pos ORDER BY (b.x2 - b.x1) * (b.y2 - b.y1) DESC, b.pos) AS r
  FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.pos <> b.pos
  WHERE {INTER} / greatest((a.x2 - a.x1) * (a.y2 - a.y1), 1.0) >= 0.6 AND (b.x2 - b.x1) * (b.y2 - b.y1) >= 1.5 * (a.x2 - a.x1) * (a.y2 - a.y1)),
h AS (SELECT track, box_of, count(*) AS c FROM m WHERE r = 1 GROUP BY ALL),
t AS (SELECT track, sum(c) AS c FROM h GROUP BY track), k AS (SELECT track, box_of FROM h QUALIFY row_number() OVER (PARTITION BY track ORDER BY c DESC, box_of) = 1),
n AS (SELECT track, count(*) AS n FROM boxes GROUP BY track)
SELECT n.track, n, round(coalesce(c, 0) / n, 9) AS frac, box_of AS container FROM n LEFT JOIN t USING (track) LEFT JOIN k USING (track)""",
)
def j7(spark, sf_dir):
    return matching.containment(boxes(spark, sf_dir), ["frame"], "track", 0.6, 1.5).withColumn("frac", F.round("frac", 9))


@query("j8_not_done", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)")
def j8(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("toxic = 0")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("j9_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j9(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, sf_dir, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("a1_size_binned_recall", f"WITH RECURSIVE {BOXES}, v AS (SELECT * FROM boxes WHERE is_truth OR score >= 0.02), {greedy_sql(0.3, 'v')}{recall_sql('v', 'frame', '')}")
def a1(spark, sf_dir):
    return recall(spark, sf_dir, [0.02]).drop("threshold")


def recall(spark, sf_dir, thresholds):
    b = boxes(spark, sf_dir).withColumn("bin", bx.size_bin(bx.side_min()))
    out = metrics.binned_recall(matching.outcomes(b, ["frame"], 0.3, ["bin"]), thresholds)
    return out.withColumns({"recall": F.round("recall", 9), "precision": F.round("precision", 9)})


@query(
    "a1_recall_at_thresholds",
    f"""WITH RECURSIVE {BOXES}, v AS (SELECT threshold, boxes.* FROM boxes, (VALUES (0.0::DOUBLE), (0.03::DOUBLE), (0.06::DOUBLE)) w(threshold) WHERE is_truth OR score >= threshold),
{greedy_sql(0.3, 'v', 'threshold, frame')}{recall_sql('v', 'threshold, frame', 'threshold')}""",
)
def a1_sweep(spark, sf_dir):
    """All thresholds from one match of each frame."""
    return recall(spark, sf_dir, [0.0, 0.03, 0.06])


OVERLAP = f"""WITH {BOXES}, h AS (SELECT a.frame, a.pos, max(CASE WHEN {IOU} >= 0.3 THEN 1 ELSE 0 END) AS hit FROM boxes a LEFT JOIN boxes b ON a.frame = b.frame AND NOT b.is_truth WHERE a.is_truth GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS gt, CAST(coalesce(sum(hit), 0) AS BIGINT) AS reachable FROM h"""


@query("a1_recall_ceiling", OVERLAP)
def a1_ceiling(spark, sf_dir):
    """Truths that some box overlaps enough, before any one-to-one matching."""
    b = boxes(spark, sf_dir)
    near = matching.iou_pairs(b.where("is_truth"), b.where(~F.col("is_truth")), ["frame"], 0.3, strict=False).select("frame", F.col("a_pos").alias("pos"), F.lit(1).alias("hit")).distinct()
    return b.where("is_truth").join(near, ["frame", "pos"], "left").agg(F.count(F.lit(1)).alias("gt"), F.count("hit").alias("reachable"))


@query(
    "g8_suppression_clusters",
    f"""WITH RECURSIVE {BOXES}, o AS (SELECT a.frame, a.pos, list(b.pos) FILTER (WHERE {IOU} >= 0.5) AS near FROM boxes a JOIN boxes b ON a.frame = b.frame GROUP BY a.frame, a.pos),
p AS (SELECT o.*, row_number() OVER (PARTITION BY o.frame ORDER BY s.score DESC, o.pos) AS r FROM o JOIN boxes s ON s.frame = o.frame AND s.pos = o.pos),
m AS (SELECT DISTINCT frame, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS heads, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS head FROM boxes
  UNION ALL SELECT frame, r, CASE WHEN h IS NULL THEN list_append(heads, pos) ELSE heads END, pos, coalesce(h, pos)
  FROM (SELECT m.frame, p.r, m.heads, p.pos, list_filter(m.heads, lambda x: list_contains(p.near, x))[1] AS h FROM m JOIN p ON p.frame = m.frame AND p.r = m.r + 1) t)
SELECT frame, pos, head FROM m WHERE pos IS NOT NULL""",
)
def g8(spark, sf_dir):
    return matching.clusters(boxes(spark, sf_dir), ["frame"], 0.5)


def seam_sql(axis: str, other: str) -> str:
    """Pairs of boxes that a seam on an axis cut."""
    return f"""SELECT a.frame, a.pos AS u, b.pos AS v FROM boxes a JOIN boxes b ON a.frame = b.frame, (VALUES (48, 64), (96, 112)) s(start, stop)
  WHERE abs(a.{axis}2 - stop) <= 6 AND a.{axis}1 < start AND abs(b.{axis}1 - start) <= 6 AND b.{axis}2 > stop AND greatest(a.{other}2, b.{other}2) > least(a.{other}1, b.{other}1)
  AND (least(a.{other}2, b.{other}2) - greatest(a.{other}1, b.{other}1)) / (greatest(a.{other}2, b.{other}2) - least(a.{other}1, b.{other}1)) >= 0.2"""


@query(
    "g7_rejoin_at_seams",
    f"""WITH RECURSIVE {BOXES}, e AS ({seam_sql('x', 'y')} UNION {seam_sql('y', 'x')}), d AS (SELECT frame, u, v FROM e WHERE u <> v UNION SELECT frame, v, u FROM e WHERE u <> v),
r(frame, pos, seen) AS (SELECT DISTINCT frame, u, u FROM d UNION SELECT r.frame, r.pos, d.v FROM r JOIN d ON d.frame = r.frame AND d.u = r.seen)
SELECT frame, pos, min(seen) AS piece_of FROM r GROUP BY frame, pos""",
)
def g7(spark, sf_dir):
    bands = [(48, 64), (96, 112)]
    return matching.rejoin(boxes(spark, sf_dir), ["frame"], (bands, bands), 6.0, 0.2)
