"""The search for near duplicates leaves few plans in the driver: what a table holds is counted while it is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.llm import components as C
from framelake.llm import jaccard, scratch


def queries(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_a_round_of_the_components_is_one_query(spark, monkeypatch):
    paths, new_path = [], C.new_path
    monkeypatch.setattr(C, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51), (60, 60)], "a long, b long")
    before = queries(spark)
    found = C.components(edges)
    assert len(paths) > 2 and queries(spark) - before == len(paths)
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(21)] + [(50, 50), (51, 50)]
    # without edges there is no round
    paths.clear()
    assert C.components(edges.where("a > 99")).collect() == [] and len(paths) == 1


def test_aggregates_come_with_the_write(spark):
    rows = spark.range(100, numPartitions=7).withColumn("k", F.col("id") % 3)
    before = queries(spark)
    table, seen = scratch.measured(rows, "t", n=F.count(F.lit(1)), total=F.sum("id"))
    none, n = scratch.counted(rows.where("id > 99"), "t")
    assert (seen["n"], seen["total"], n) == (100, 4950, 0) and queries(spark) - before == 2
    assert sorted(table.collect()) == sorted(rows.collect()) and none.count() == 0


def test_near_duplicates_take_few_queries(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(words), " ".join(reversed(words)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = queries(spark)
    assert sorted(r.doc_id for r in jaccard.survivors(docs, 5, 8, 10).collect()) == [0, 3, 4, 5]
    assert queries(spark) - before <= 24
