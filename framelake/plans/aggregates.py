"""A2-A14: aggregations and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import quantiles
from ..operators import metrics
from ..registry import query
from .base import BOXES, RUNS, boxes, runs, table
from .projections import EDGES


@query(
    "a2_counters",
    f"""WITH {RUNS} SELECT 'good found' AS metric, CAST(count(*) FILTER (WHERE answer = 1) AS BIGINT) AS ok, count(*) AS total FROM runs WHERE truth = 1
UNION ALL SELECT 'bad rejected', count(*) FILTER (WHERE answer = 0), count(*) FROM runs WHERE truth = 0
UNION ALL SELECT 'large right', count(*) FILTER (WHERE ok), count(*) FROM runs WHERE side >= 64""",
)
def a2(spark, sf_dir):
    c = F.col
    return metrics.counters(runs(spark, sf_dir), {"good found": (c("truth") == 1, c("answer") == 1), "bad rejected": (c("truth") == 0, c("answer") == 0), "large right": (c("side") >= 64, c("ok"))})


@query("a3_accuracy_by_group", f"WITH {RUNS} SELECT truth, lang, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS share FROM runs GROUP BY truth, lang")
def a3(spark, sf_dir):
    return metrics.accuracy(runs(spark, sf_dir), ["truth", "lang"], "ok").withColumn("share", F.round("share", 9))


@query("a3_accuracy_by_size", f"WITH {RUNS} SELECT truth, {EDGES.format('side')} AS bin, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS ok, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS share FROM runs GROUP BY ALL")
def a3_size(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("bin", bx.size_bin(F.col("side")))
    return metrics.accuracy(r, ["truth", "bin"], "ok").withColumn("share", F.round("share", 9))


@query("a3_pivot", f"WITH {RUNS} SELECT source, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (WHERE lang = 'en'), 9) AS en, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) FILTER (WHERE lang = 'fr'), 9) AS fr FROM runs GROUP BY source")
def a3_pivot(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("source").pivot("lang", ["en", "fr"]).agg(F.round(F.avg(F.col("ok").cast("double")), 9))


@query(
    "a3_confusion",
    f"""WITH {RUNS}, p AS (SELECT truth, choice, count(*) AS n FROM runs GROUP BY ALL)
SELECT truth, choice, n, round(n / sum(n) OVER (PARTITION BY truth), 9) AS share, CAST(row_number() OVER (PARTITION BY truth ORDER BY n DESC, choice) AS INTEGER) AS place FROM p QUALIFY place <= 3""",
)
def a3_confusion(spark, sf_dir):
    return metrics.confusion(runs(spark, sf_dir), "truth", "choice", 3).withColumn("share", F.round("share", 9))


@query(
    "a3_coverage",
    f"""WITH {RUNS} SELECT truth, t AS threshold, CAST(count(*) FILTER (WHERE confidence >= t) AS BIGINT) AS kept, count(*) AS n, round(count(*) FILTER (WHERE confidence >= t) / count(*), 9) AS share,
round(count(*) FILTER (WHERE confidence >= t AND ok) / nullif(count(*) FILTER (WHERE confidence >= t), 0), 9) AS right_share FROM runs, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(t) GROUP BY truth, t""",
)
def a3_coverage(spark, sf_dir):
    out = metrics.coverage(runs(spark, sf_dir), ["truth"], "confidence", "ok", [0.5, 0.7, 0.9])
    return out.select("truth", "threshold", "kept", "n", F.round("share", 9).alias("share"), F.round("right", 9).alias("right_share"))


@query(
    "a4_log_vote",
    f"""WITH {RUNS}, l AS (SELECT source, i, ln(greatest(probs[i + 1], 1e-9)) AS s FROM runs, range(4) t(i)), v AS (SELECT source, i, round(sum(s), 6) AS s, count(*) AS n FROM l GROUP BY ALL)
SELECT source, CAST(i AS INTEGER) AS winner, n FROM v WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, i) = 1""",
)
def a4(spark, sf_dir):
    return metrics.log_vote(runs(spark, sf_dir), ["source"], "probs")


@query(
    "a5_label_vote",
    f"""WITH {BOXES}, s AS (SELECT track, label, sum(CAST(round(score * 100) AS BIGINT)) AS s, min(frame * 100 + pos) AS f FROM boxes GROUP BY ALL), t AS (SELECT *, round(s / sum(s) OVER (PARTITION BY track), 3) AS share FROM s)
SELECT track, label, share FROM t QUALIFY row_number() OVER (PARTITION BY track ORDER BY share DESC, f) = 1""",
)
def a5(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("w", F.round(F.col("score") * 100).cast("long")).withColumn("seen", F.col("frame") * 100 + F.col("pos"))
    return metrics.label_vote(b, ["track"], "label", "w", "seen").select("track", "label", F.col("labels")[F.col("label")].alias("share"))


MEMBERS = f"""{BOXES}, m AS (SELECT CASE WHEN pos % 5 = 4 THEN NULL ELSE track END AS track, CASE WHEN pos % 3 = 2 THEN NULL ELSE label END AS target FROM boxes),
z AS (SELECT track, count(*) AS n FROM m WHERE track IS NOT NULL GROUP BY track HAVING count(*) >= 3), k AS (SELECT m.* FROM m JOIN z USING (track)),
p AS (SELECT track, target, count(*) AS c FROM k WHERE target IS NOT NULL GROUP BY ALL), o AS (SELECT track, sum(c) AS cnt, max(c) AS top FROM p GROUP BY track),
f AS (SELECT target, count(*) AS pieces FROM p JOIN o USING (track) WHERE c >= greatest(2.0, 0.1 * cnt) GROUP BY target)"""


@query(
    "a6_track_quality",
    f"""WITH {MEMBERS} SELECT d.gt AS gt_boxes, d.n AS detections, round(d.t / d.gt, 9) AS recall_det, round((d.n - d.t) / d.n, 9) AS fp_share, d.g AS gt_objects, i.k AS tracks, round(i.n / d.n, 9) AS coverage,
round(u.maj / u.tr, 9) AS purity, u.imp AS impure_tracks, round(i.fp / i.n, 9) AS fp_in_tracks, round(q.a, 9) AS pieces_per_object, round(q.b, 9) AS objects_in_one_piece
FROM (SELECT count(*) AS n, count(target) AS t, count(DISTINCT target) AS g, (SELECT count(*) FROM boxes WHERE is_truth) AS gt FROM m) d, (SELECT count(*) AS n, count(*) - count(target) AS fp, count(DISTINCT track) AS k FROM k) i,
(SELECT sum(top) AS maj, sum(cnt) AS tr, count(*) FILTER (WHERE top < cnt) AS imp FROM o) u, (SELECT avg(pieces) AS a, avg(CASE WHEN pieces = 1 THEN 1.0 ELSE 0.0 END) AS b FROM f) q""",
)
def a6(spark, sf_dir):
    members = boxes(spark, sf_dir).select(F.when(F.col("pos") % 5 != 4, F.col("track")).alias("track"), F.when(F.col("pos") % 3 != 2, F.col("label")).alias("target"), "is_truth")
    out = metrics.track_quality(members, F.count_if("is_truth"), 3)
    return out.withColumns({c: F.round(c, 9) for c, t in out.dtypes if t == "double"})


@query("a7_weighted_mean", "SELECT c_mktsegment, round(sum(greatest(c_nationkey, 1) * c_acctbal) / sum(greatest(c_nationkey, 1)), 6) AS c_acctbal FROM customer GROUP BY c_mktsegment")
def a7(spark, sf_dir):
    return metrics.weighted_mean(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_nationkey", ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


LEVELS = f"{BOXES}, l AS (SELECT *, CASE WHEN score >= 0.05 THEN 'keep' WHEN score >= 0.02 THEN 'ignore' ELSE 'drop' END AS level FROM boxes)"


def levels(spark, sf_dir):
    level = F.when(F.col("score") >= 0.05, "keep").when(F.col("score") >= 0.02, "ignore").otherwise("drop")
    return metrics.levels(boxes(spark, sf_dir).withColumn("level", level), "level", "label", "keep", "ignore", ["frame"])


@query("a8_level_counters", f"WITH {LEVELS} SELECT level, label, count(*) AS n, round(median(sqrt((x2 - x1) * (y2 - y1))) FILTER (WHERE level = 'keep'), 1) AS median_side FROM l GROUP BY level, label")
def a8(spark, sf_dir):
    return levels(spark, sf_dir)[0]


@query("a8_ignored_area", f"WITH {LEVELS}, s AS (SELECT frame, sum(CASE WHEN level = 'keep' THEN (x2 - x1) * (y2 - y1) ELSE 0 END) AS k, sum(CASE WHEN level = 'ignore' THEN (x2 - x1) * (y2 - y1) ELSE 0 END) AS g FROM l GROUP BY frame) SELECT frame, CASE WHEN k + g > 0 THEN round(g / (k + g), 9) ELSE 0.0 END AS ignored_share FROM s")
def a8_area(spark, sf_dir):
    return levels(spark, sf_dir)[1].withColumn("ignored_share", F.round("ignored_share", 9))


@query("a9_p90_floor_of_last", "SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 = CAST(floor(0.9::DOUBLE * (count(*) OVER (PARTITION BY event_type) - 1)) AS BIGINT)")
def a9a(spark, sf_dir):
    return quantiles.rank_at(table(spark, sf_dir, "events"), ["event_type"], "value", lambda n: quantiles.floor_of_last(n, 0.9))


@query("a9_p90_floor_of_count", "SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 = CAST(floor(count(*) OVER (PARTITION BY event_type) * 0.9::DOUBLE) AS BIGINT)")
def a9b(spark, sf_dir):
    return quantiles.rank_at(table(spark, sf_dir, "events"), ["event_type"], "value", lambda n: quantiles.floor_of_count(n, 0.9))


@query("a9_upper_median", "SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 = count(*) OVER (PARTITION BY event_type) // 2")
def a9m(spark, sf_dir):
    return quantiles.rank_at(table(spark, sf_dir, "events"), ["event_type"], "value", lambda n: quantiles.floor_of_count(n, 0.5))


@query(
    "a9_p90_exclusive",
    """WITH r AS (SELECT user_id, value AS v, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(max(CASE WHEN n > 10 AND i = greatest(1, least(CAST(floor(0.9::DOUBLE * (n + 1)) AS BIGINT), n - 1)) THEN v + (0.9::DOUBLE * (n + 1) - i) * (a - v) END), 6) AS value FROM r GROUP BY user_id""",
)
def a9c(spark, sf_dir):
    return quantiles.exclusive(table(spark, sf_dir, "events"), ["user_id"], "value", 0.9).withColumn("value", F.round("value", 6))


@query("a9_p90_linear", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS value FROM events GROUP BY event_type")
def a9d(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(quantiles.linear(F.col("value"), 0.9), 6).alias("value"))


@query(
    "a10_detections_per_frame",
    f"""WITH {BOXES}, f AS (SELECT frame, count(*) FILTER (WHERE NOT is_truth) AS n FROM boxes GROUP BY frame)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE n > 0) AS frames_with, round(sum(n) / count(*) FILTER (WHERE n > 0), 2) AS per_detected_frame, min(frame) FILTER (WHERE n > 0) AS "first", max(frame) FILTER (WHERE n > 0) AS "last", CAST(max(n) AS BIGINT) AS most FROM f""",
)
def a10(spark, sf_dir):
    return metrics.per_frame(boxes(spark, sf_dir).groupBy("frame").agg(F.count_if(~F.col("is_truth")).alias("n")), "n", "frame")


@query("a11_distinct_by_key", f"WITH {BOXES} SELECT label, count(DISTINCT CAST(track AS VARCHAR) || '/' || CAST(frame AS VARCHAR)) AS n FROM boxes GROUP BY label")
def a11(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("label").agg(F.count_distinct("track", "frame").alias("n"))


@query(
    "a13_track_summary",
    f"""WITH {BOXES} SELECT track, count(*) AS n_detected, min(frame) AS sample_min, max(frame) AS sample_max, round(min(frame / 30.0::DOUBLE), 3) AS t_min_s, round(max(frame / 30.0::DOUBLE), 3) AS t_max_s,
round(round(avg(CAST(round(score * 100) AS BIGINT)), 9), 3) AS score_mean, round(median(greatest(x2 - x1, y2 - y1)), 1) AS size_median_px FROM boxes GROUP BY track""",
)
def a13(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("t", F.col("frame") / F.lit(30.0)).withColumn("score", F.round(F.col("score") * 100).cast("long"))
    return metrics.track_summary(b, ["track"], "frame", "t", "score", bx.side_max())


@query("a14_size_spread", f"WITH {BOXES} SELECT track, round(quantile_cont(greatest(x2 - x1, y2 - y1), 0.9) / greatest(quantile_cont(greatest(x2 - x1, y2 - y1), 0.1), 1.0), 2) AS spread FROM boxes GROUP BY track")
def a14(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("track").agg(metrics.spread(bx.side_max()).alias("spread"))
