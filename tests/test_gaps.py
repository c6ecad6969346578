"""Rows that share an index are made one where the ranges are made: they move once for that and for their neighbours."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from framelake import registry
from framelake.operators import ordered


def moved(spark, run) -> int:
    """Rows that all tasks of what `run` starts wrote for a shuffle."""
    sc, group, total = spark.sparkContext, uuid.uuid4().hex, 0
    sc.setJobGroup(group, "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    for stage in {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}:
        if tracker.getStageInfo(stage) is None:
            continue  # it was skipped
        tasks = store.taskList(stage, 0, 100_000)
        for k in range(tasks.size()):
            metrics = tasks.apply(k).taskMetrics()
            if metrics.isDefined():
                total += metrics.get().shuffleWriteMetrics().recordsWritten()
    return total


def test_gaps_between_the_greatest_values(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3]), rnd.randrange(400), rnd.choice([None, 1.0, 2.5, 7.0])) for _ in range(900)]
    best: dict = {}
    for k, i, v in rows:
        own = best.setdefault(k, {})
        own[i] = max((x for x in (own.get(i), v) if x is not None), default=None)
    want = {}
    for k, own in best.items():
        at = sorted(own)
        for i, n in zip(at, [*at[1:], None], strict=True):
            want[k, i] = own[i]
            for s in range(i + 1, n or i):
                want[k, s] = None if own[i] is None or own[n] is None else (1 - (s - i) / (n - i)) * own[i] + (s - i) / (n - i) * own[n]
    got = ordered.fill_gaps(spark.createDataFrame(rows, "k long, i long, v double").repartition(3), ["k"], "i", ["v"], 6, F.max).collect()
    assert len(got) == len(want) and {(r.k, r.i) for r in got} == set(want)
    assert all((r.v is None) == (want[r.k, r.i] is None) and (r.v is None or abs(r.v - want[r.k, r.i]) < 1e-5) for r in got)


def test_events_move_twice(spark):
    """Into their ranges, and to their neighbours in these."""
    sf_dir = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert moved(spark, lambda: registry.queries()["w3_gap_fill"](spark, sf_dir).write.format("noop").mode("overwrite").save()) < 2.4 * n
