"""Measures over matched boxes, tracks and classification runs. Labels are opaque."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as bx


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binned_recall(outcomes: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, bin, gt, hits, pred, tp, recall, precision by size of truth, at each score threshold; bin -1 has the totals. Truths of no bin count nowhere, boxes found only in totals.

    outcomes: a row for each box (from matching.outcomes) with its bin. All thresholds and totals come from one pass: sums by threshold and bin, which then go to their totals too.
    """
    c, at = F.col, F.col("threshold")
    rows = outcomes.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(c("is_truth") | (c("score") >= at))
    counted = c("is_truth") & c("bin").isNotNull()
    hit = F.coalesce(c("taken") >= at, F.lit(False))
    sums = rows.groupBy("threshold", F.when(counted, c("bin")).alias("own")).agg(
        F.count_if(counted).alias("gt"), F.count_if(counted & hit).alias("hits"), F.count_if(~c("is_truth")).alias("pred"), F.count_if(~c("is_truth") & hit).alias("tp")
    )
    both = sums.withColumn("bin", F.explode(F.array(c("own"), F.lit(-1)))).where("bin is not null")
    total = lambda x: F.when(c("bin") == -1, F.sum(x)).alias(x)
    out = both.groupBy("threshold", "bin").agg(F.sum("gt").alias("gt"), F.sum("hits").alias("hits"), total("pred"), total("tp"))
    # a threshold without a truth of any bin has no rows, as nothing can be said of recall
    seen = out.withColumn("__some", F.sum(F.when(c("bin") == -1, c("gt"))).over(Window.partitionBy("threshold"))).where("__some > 0").drop("__some")
    return seen.withColumns({"recall": ratio(c("hits"), c("gt")), "precision": F.when(c("bin") == -1, ratio(c("tp"), c("pred")))})


def track_quality(members: DataFrame, truths: Column | int, least: int = 1) -> DataFrame:
    """One row of measures. members: track, target (null: false positive), one row a detection, track null if in none; truths: the number of true boxes, or an aggregate over members that gives it.

    Everything is sums over one small table of (track, target) counts: no second pass over members.
    """
    c, w = F.col, Window.partitionBy("track")
    cells = members.groupBy("track", "target").agg(F.count(F.lit(1)).alias("c"), (truths if isinstance(truths, Column) else F.lit(0)).cast("long").alias("truths"))
    hit = F.when(c("target").isNotNull(), c("c"))
    cells = cells.withColumns({"n": F.sum("c").over(w), "count": F.sum(hit).over(w), "top": F.max(hit).over(w), "head": F.row_number().over(w.orderBy("target")) == 1})
    kept = c("track").isNotNull() & (c("n") >= least)
    once = lambda x: F.sum(F.when(kept & c("head"), x))  # noqa: E731  a track's own figures, from one of its rows
    by_target = cells.groupBy("target").agg(
        F.sum("c").alias("c"), F.sum("truths").alias("truths"), F.count_if(kept & c("target").isNotNull() & (c("c") >= F.greatest(F.lit(2.0), 0.1 * c("count")))).alias("pieces"),
        once(c("n")).alias("in_tracks"), once(F.lit(1)).alias("tracks"), once(c("top")).alias("majority"), once(c("count")).alias("true_in"), once((c("top") < c("count")).cast("long")).alias("impure_tracks"),
    )
    none = lambda x: F.coalesce(x, F.lit(0))
    some = c("pieces") > 0
    row = by_target.agg(
        none(F.sum("truths")).alias("truths"), none(F.sum("c")).alias("detections"), none(F.sum(F.when(c("target").isNotNull(), c("c")))).alias("true_detections"), F.count("target").alias("gt_objects"),
        *[none(F.sum(x)).alias(x) for x in ("in_tracks", "tracks", "majority", "true_in", "impure_tracks")],
        F.coalesce(F.avg(F.when(some, c("pieces"))), F.lit(0.0)).alias("pieces_per_object"), F.coalesce(F.avg(F.when(some, (c("pieces") == 1).cast("double"))), F.lit(0.0)).alias("objects_in_one_piece"),
    )
    gt = c("truths") if isinstance(truths, Column) else F.lit(truths).cast("long")
    return row.select(
        gt.alias("gt_boxes"), "detections", ratio(c("true_detections"), gt).alias("recall_det"), ratio(c("detections") - c("true_detections"), c("detections")).alias("fp_share"),
        "gt_objects", "tracks", ratio(c("in_tracks"), c("detections")).alias("coverage"), ratio(c("majority"), c("true_in")).alias("purity"), "impure_tracks",
        ratio(c("in_tracks") - c("true_in"), c("in_tracks")).alias("fp_in_tracks"), "pieces_per_object", "objects_in_one_piece",
    )


def weighted_mean(df: DataFrame, keys: list[str], weight: str, values: list[str]) -> DataFrame:
    """Means of values by key, weighted by max(weight, 1)."""
    w = F.greatest(F.col(weight), F.lit(1)).cast("double")
    return df.groupBy(*keys).agg(*[(F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values])


def counters(df: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """metric, ok, total: for each metric (population, success), rows of the population, and those of them that succeed; nulls are in no population."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(p, F.lit(False)).alias("p"), F.coalesce(s, F.lit(False)).alias("s")) for k, (p, s) in metrics.items()]))
    return df.select(rows.alias("m")).where("m.p").groupBy("m.metric").agg(F.count_if("m.s").alias("ok"), F.count(F.lit(1)).alias("total"))


def accuracy(df: DataFrame, keys: list[str], ok: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(ok).alias("ok"), F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("share"))


def confusion(df: DataFrame, truth: str, answer: str, top: int = 6) -> DataFrame:
    """truth, answer, n, share, place: the `top` most frequent answers for each truth (ties by name)."""
    pairs = df.groupBy(truth, answer).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(truth)
    ranked = pairs.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), answer)))
    return ranked.where(F.col("place") <= top)


def coverage(df: DataFrame, keys: list[str], confidence: str, ok: str, thresholds: list[float]) -> DataFrame:
    """keys, threshold, kept, n, share, right: one pass for all thresholds."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    kept = F.col(confidence) >= F.col("threshold")
    out = rows.groupBy(*keys, "threshold").agg(F.count_if(kept).alias("kept"), F.count(F.lit(1)).alias("n"), F.count_if(kept & F.col(ok)).alias("__ok"))
    return out.select(*keys, "threshold", "kept", "n", (F.col("kept") / F.col("n")).alias("share"), F.when(F.col("kept") > 0, F.col("__ok") / F.col("kept")).alias("right"))


def log_vote(df: DataFrame, keys: list[str], probs: str, least: int = 2) -> DataFrame:
    """keys, winner, n: the choice with the greatest sum of log(max(p, 1e-9)), the first of equals; keys with `least` items and more."""
    long = df.select(*keys, F.posexplode(probs).alias("choice", "p"))
    sums = long.groupBy(*keys, "choice").agg(F.sum(F.log(F.greatest("p", F.lit(1e-9)))).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(*keys).agg(F.max_by("choice", F.struct("s", -F.col("choice"))).alias("winner"), F.max("n").alias("n")).where(F.col("n") >= least)


def label_vote(df: DataFrame, keys: list[str], label: str, score: str, order: str) -> DataFrame:
    """keys, label, labels (shares to 3 places): the label with the greatest sum of scores, of equals that seen first."""
    sums = df.groupBy(*keys, label).agg(F.sum(score).alias("s"), F.min(order).alias("first"))
    total = F.sum("s").over(Window.partitionBy(*keys))
    shares = sums.withColumn("share", F.round(F.col("s") / total, 3))
    return shares.groupBy(*keys).agg(F.max_by(label, F.struct("share", -F.col("first"))).alias("label"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "share")))).alias("labels"))


def levels(df: DataFrame, level: str, reason: str, kept: str, ignored: str, frame: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counters: (level, reason, n, median_side of kept boxes); and per frame the share of ignored area."""
    side = F.sqrt(F.greatest(bx.area(), F.lit(0.0)))
    counts = df.groupBy(level, reason).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.when(F.col(level) == kept, side)), 1).alias("median_side"))
    of = lambda what: F.sum(F.when(F.col(level) == what, bx.area()).otherwise(0.0))
    share = df.groupBy(*frame).agg(ratio(of(ignored), of(kept) + of(ignored)).alias("ignored_share"))
    return counts, share


def per_frame(df: DataFrame, n: str, index: str) -> DataFrame:
    """One row: totals of detections by frame. df: a row for each frame with how many it has."""
    some = F.col(n) > 0
    return df.agg(
        F.sum(n).alias("total"), F.count_if(some).alias("frames_with"), F.round(ratio(F.sum(n), F.count_if(some)), 2).alias("per_detected_frame"),
        F.min(F.when(some, F.col(index))).alias("first"), F.max(F.when(some, F.col(index))).alias("last"), F.coalesce(F.max(n), F.lit(0)).alias("most"),
    )


def track_summary(df: DataFrame, keys: list[str], index: str, time: str, score: str, size: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_detected"), F.min(index).alias("sample_min"), F.max(index).alias("sample_max"), F.round(F.min(time), 3).alias("t_min_s"),
        F.round(F.max(time), 3).alias("t_max_s"), F.round(F.avg(score), 3).alias("score_mean"), F.round(F.median(size), 1).alias("size_median_px"),
    )


def spread(size: Column) -> Column:
    """90th over 10th percentile of sizes, the latter at least 1, to 2 places."""
    return F.round(F.percentile(size, F.lit(0.9)) / F.greatest(F.percentile(size, F.lit(0.1)), F.lit(1.0)), 2)
