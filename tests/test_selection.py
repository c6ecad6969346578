"""Exact ranks by distributed selection: the same as sorting, without sorting a group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tasks import most_read
from test_plans import plan

from framelake import registry
from framelake.functions import quantiles

LEAST = 500


def table(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


def shapes():
    rnd = random.Random(4)
    return {
        "even": [rnd.random() for _ in range(9000)], "one value": [3.5] * 4000, "two values": [0.0] * 3000 + [1.0] * 2500, "small": [5.0, 1.0, 4.0], "alone": [7.0],
        "steep": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(6000)], "mostly one": [2.0] * 5000 + [rnd.gauss(2, 1) for _ in range(3000)],
        None: [float(x) for x in range(3000)] + [float("nan")] * 40, "nulls": [None] * 20,
    }


def order(v):
    return (v != v, v)


@pytest.mark.parametrize("places", [[0.0], [0.9], [0.5, 1.0], [0.123, 0.124, 0.999]])
def test_values_at_ranks(spark, places):
    groups = shapes()
    index = lambda n: [F.floor(F.lit(p) * (n - 1)) for p in places]
    got = {(r.k, r.place): (r.n, repr(r.value)) for r in quantiles.ranked(table(spark, groups), ["k"], "v", index, LEAST).collect()}
    want = {}
    for k, values in groups.items():
        values = sorted((v for v in values if v is not None), key=order)
        for i, p in enumerate(places):
            if values:
                want[k, i] = (len(values), repr(values[int(p * (len(values) - 1))]))
    assert got == want


def test_all_rows_as_one_group_and_none(spark):
    df = table(spark, {"a": [float(x % 1009) for x in range(8000)]})
    assert [r.value for r in quantiles.ranked(df, [], "v", lambda n: [n - 1, F.lit(0), n, F.lit(-1)], LEAST).orderBy("place").collect()] == [1008.0, 0.0]
    assert quantiles.rank_at(df.where("false"), ["k"], "v", lambda n: F.lit(0)).count() == 0


def test_exclusive_is_the_definition(spark):
    from statistics import quantiles as by_definition

    groups = {k: v for k, v in shapes().items() if k not in (None, "nulls", "steep")}
    got = {r.k: r.value for r in quantiles.exclusive(table(spark, groups), ["k"], "v", 0.9).collect()}
    assert got == {k: pytest.approx(by_definition(v, n=10)[8]) if len(v) > 10 else None for k, v in groups.items()}


def test_no_task_sorts_a_group(spark):
    """One group has nearly all rows; what a task gets by a shuffle is its interval, partial sums and sketches."""
    rnd = random.Random(2)
    df = table(spark, {"hot": [rnd.gauss(0, 1) for _ in range(60_000)], **{str(k): [1.0, 2.0] for k in range(40)}})
    df.cache().count()
    got = {}
    most = most_read(spark, lambda: got.update((r.k, r.value) for r in quantiles.ranked(df, ["k"], "v", lambda n: [F.floor(n * 0.9)], LEAST).collect()))
    values = sorted(r.v for r in df.where("k = 'hot'").collect())
    assert got["hot"] == values[54_000] and 0 < most <= LEAST
    df.unpersist()


@pytest.mark.parametrize("name", ["a9_p90_floor_of_last", "a9_p90_floor_of_count", "a9_upper_median", "a9_p90_exclusive"])
def test_plans_rank_nothing(spark, sf_dir, name):
    assert "Window" not in plan(registry.queries()[name](spark, sf_dir))
