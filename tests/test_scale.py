"""What is streamed, cut into blocks or ranked in pieces gives the same as in one piece."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import ordered, sampling
from framelake.sources import annotations as an
from framelake.sources import scratch


def test_thinning_over_batches(spark):
    rnd = random.Random(0)
    rows = [(k % 7 if k % 11 else None, k % 2, rnd.choice([None, *[x / 4 for x in range(200)]])) for k in range(900)]
    want = []
    for key in {r[:2] for r in rows}:
        last = None
        for t in sorted(r[2] for r in rows if r[:2] == key and r[2] is not None):
            if last is None or t - last >= 1.0 - 1e-3:
                last = t
                want.append((*key, t))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = [tuple(r) for r in ordered.thinned(spark.createDataFrame(rows, "k long, l int, t double"), ["k", "l"], "t", 1.0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", ["1k", "1m"])
def test_lines_are_numbered_over_blocks(spark, size):
    path = scratch.shared(spark, "lines")
    texts = {f"{n}.jsonl": ["" if k % 9 == 4 else f"{n} line {k} " + "x" * (k % 70) for k in range(n)] for n in (0, 1, 150, 400)}
    for name, lines in texts.items():
        scratch.write_text(spark, f"{path}/{name}", "".join(f"{x}\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = an.lines(spark, [f"{path}/{n}" for n in texts])
        got = {(r.path.rpartition("/")[2], r.line, r.value) for r in df.collect()}
        marks = an.in_order(spark, [f"{path}/400.jsonl"]).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(n, k, x) for n, lines in texts.items() for k, x in enumerate(lines) if x}
    assert [r.value for r in marks] == texts["400.jsonl"]


def test_resume_scan_over_blocks(spark):
    path = scratch.shared(spark, "resume") + "/a.jsonl"
    lines = [json.dumps({"sample_index": k}) for k in range(300)]
    lines[211] = lines[250] = "{bro"
    scratch.write_text(spark, path, "\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert {r.sample_index for r in an.done(an.lines(spark, [path]), False).collect()} == set(range(211))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strata_are_dealt_in_their_order(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(10), rnd.choice([None, 0, 1])) for k in rnd.sample(range(5000), 700)]
    fits = [("a", 15, lambda r: r[1] < 3), ("b", 40, lambda r: r[1] < 6), ("c", 5, lambda r: r[2] == 1), ("d", 30, lambda r: True)]
    want, taken = set(), set()
    for name, quota, ok in fits:
        some = sorted(r[0] for r in rows if ok(r) and r[0] not in taken)[:quota]
        taken |= set(some)
        want |= {(k, name) for k in some}
    columns = [("a", 15, F.col("x") < 3), ("b", 40, F.col("x") < 6), ("c", 5, F.col("y") == 1), ("d", 30, F.lit(True))]
    got = sampling.by_strata(spark.createDataFrame(rows, "id long, x int, y int"), columns, ["id"], [F.col("id")])
    assert {(r.id, r.stratum) for r in got.collect()} == want


def test_places_are_gapless(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x").alias("w"))
    got = ordered.numbered(df, ["v"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(5000)) and [r.v for r in got] == sorted(r.v for r in got)


def test_a_json_file_is_replaced_whole(spark):
    path = scratch.shared(spark, "summary") + "/a.json"
    for value in ([1], {"b": 2}):
        scratch.write_json(spark, path, value)
        assert json.loads(spark.read.text(path).first().value) == value


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId = "none"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    Session.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError):
        scratch.shared_root(Session())
    Session.sparkContext.master = "local[4]"
    assert scratch.shared_root(Session()) == scratch.shared_root(Session())
