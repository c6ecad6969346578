"""What tasks have read, by Spark's own counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable


def most_read(spark, run: Callable[[], object]) -> int:
    """The most rows that any one task of what `run` starts got from a shuffle."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, tracker, most = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for stage in {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}:
        if tracker.getStageInfo(stage) is None:
            continue  # it was skipped
        tasks = store.taskList(stage, 0, 100_000)
        for k in range(tasks.size()):
            metrics = tasks.apply(k).taskMetrics()
            if metrics.isDefined():
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most
