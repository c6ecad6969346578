"""The data sources: files pruned by a filter, parts of large files, errors counted over tasks."""

from __future__ import annotations

import json
import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from framelake.sources import annotations as an
from framelake.sources import lines
from framelake.sources.scratch import shared, write_text


def local(path):
    return path.removeprefix("file://")


@pytest.fixture(scope="module")
def folder(spark):
    path = shared(spark, "chunk-files")
    os.makedirs(local(path))
    rnd = random.Random(0)
    want = {}
    for start in range(0, 1000, 100):
        text = "".join(json.dumps({"flight": "f", "sample_index": i, "stem": "é" * rnd.randint(0, 40)}) + ("\r\n" if i % 9 == 0 else "\n") + ("\n" if i % 10 == 0 else "") for i in range(start, start + 100)) + '{"flight":"f","sample_in'
        want[start] = [x.rstrip("\r") for x in text.split("\n")]
        name = f"{local(path)}/f_chunk_{start}_{start + 100}.jsonl"
        if start % 200:
            with open(name + ".zst", "wb") as f:
                f.write(zstandard.compress(text.encode()))
            with open(name, "w") as f:
                f.write("stale\n")
        else:
            with open(name, "w", newline="") as f:
                f.write(text)
        open(name.removesuffix(".jsonl") + ".done", "w").close()
    return path, want


@pytest.mark.parametrize("size", ["200", "1000", "100000000"])
def test_every_line_comes_once_with_its_place(spark, folder, size):
    path, want = folder
    df = lines.registered(spark).read.format("framelake_chunks").option("partBytes", size).load(path)
    got: dict = {}
    for r in df.orderBy("start", "block", "line").collect():
        got.setdefault(r.start, []).append(r.value)
        assert r.flight == "f" and r.end == r.start + 100 and (r.sample_index is None) == (not r.value.endswith("}"))
    assert got == {s: [x for x in v if x] for s, v in want.items()}


def test_a_range_prunes_files(spark, folder):
    path, _ = folder
    few = lines.chunks(spark, path, start=350, end=400)
    assert {r.path.rpartition("/")[2] for r in few.select("path").collect()} == {"f_chunk_300_400.jsonl.zst"} and few.count() == 50
    read = lambda **o: lines.registered(spark).read.format("framelake_chunks").options(partBytes=1000, **o).load(path)
    every, some = read(), read(**{"from": 350, "to": 601})
    assert some.rdd.getNumPartitions() < every.rdd.getNumPartitions() and {r.start for r in some.select("start").distinct().collect()} == {300, 400, 500, 600}
    # plans over one relation don't disturb each other
    assert every.where("sample_index >= 900").count() == 100 and every.where("sample_index is not null").count() == 1000
    # the others aren't even opened: they may be broken
    bad = shared(spark, "broken")
    os.makedirs(local(bad))
    for start, data in ((0, b"not zstd"), (100, zstandard.compress(b'{"sample_index":101}\n'))):
        for end, content in ((".jsonl.zst", data), (".done", b"")):
            with open(f"{local(bad)}/f_chunk_{start}_{start + 100}{end}", "wb") as f:
                f.write(content)
    assert [r.sample_index for r in an.frames(spark, bad, "f", 100).collect()] == [101]
    with pytest.raises(Exception, match="(?i)zstd|compress|magic|unknown"):
        an.frames(spark, bad, "f").collect()


def test_the_top_level_index_counts(spark):
    path = shared(spark, "nested")
    write_text(spark, f"{path}/f_chunk_0_9.jsonl", '{"shapes":[],"old":{"sample_index":5},"sample_index":3}\n{"old":{"sample_index":7}}\n[1]\n{"sample_index": 4}\n')
    write_text(spark, f"{path}/f_chunk_0_9.done", "")
    assert [r.sample_index for r in lines.chunks(spark, path).orderBy("line").collect()] == [3, None, None, 4]


def test_unfinished_chunks(spark):
    path = shared(spark, "open")
    write_text(spark, f"{path}/f_chunk_0_9.jsonl", '{"sample_index":3}\n')
    write_text(spark, f"{path}/g_chunk_0_9.jsonl", '{"sample_index":3}\n')
    write_text(spark, f"{path}/g_chunk_0_9.done", "")
    assert lines.chunks(spark, path, "g").count() == 1 and lines.chunks(spark, path, partial=True).count() == 1
    with pytest.raises(Exception, match="not finished"):
        lines.chunks(spark, path).count()


def test_over_the_budget_nothing_is_written(spark, tmp_path):
    path = shared(spark, "budget")

    def seen(batches):
        (tmp_path / str(random.getrandbits(60))).touch()
        yield from batches

    df = spark.range(0, 200, 1, 5).select("id", F.when(F.col("id") % 40 == 0, "lost").alias("error")).mapInPandas(seen, "id long, error string")
    with pytest.raises(Exception, match="5 rows with errors, more than 4"):
        an.append(df, path, 4)
    assert not os.path.exists(local(path)) or os.listdir(local(path)) == []
    assert len(list(tmp_path.iterdir())) == 5  # each part was evaluated once
    an.append(df, path, 5)
    an.append(df.where("error is null"), path, 0)
    assert spark.read.json(path).groupBy("error").count().collect() and spark.read.json(path).count() == 395
    assert not [x for x in os.listdir(local(path)) if x.startswith(".staging")]


def test_a_failing_task_leaves_nothing(spark):
    path = shared(spark, "failing")
    df = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.lit("x")).otherwise(F.raise_error(F.lit("boom"))).alias("value"))
    with pytest.raises(Exception, match="boom"):
        lines.write_lines(df, path)
    # tasks that were still writing when the job was aborted may leave hidden files
    assert not os.path.exists(local(path)) or not [x for x in os.listdir(local(path)) if not x.startswith(".staging")]


def test_files_have_the_names_that_rows_say(spark):
    path = shared(spark, "named")
    rows = [(f"{k % 3}.txt", str(k)) for k in range(30)] + [("empty.done", None)]
    lines.write_lines(spark.createDataFrame(rows, "file string, value string").repartition("file").sortWithinPartitions("file", "value"), path)
    assert sorted(os.listdir(local(path))) == ["0.txt", "1.txt", "2.txt", "empty.done"]
    assert sorted(open(f"{local(path)}/1.txt").read().split()) == sorted(str(k) for k in range(30) if k % 3 == 1)


def test_texts_are_numbered_where_they_are_read(spark, tmp_path):
    """Files of several blocks, with empty lines: numbers are places in the file, and texts don't move."""
    for f in "ab":
        (tmp_path / f"{f}.jsonl").write_text("".join(f"{f}{k}\n" if k % 7 else "\n" for k in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = an.lines(spark, [f"file://{tmp_path}"])
        assert "Window [row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.path[-7], r.line, r.value) for r in found.collect()} == {(f, k, f"{f}{k}") for f in "ab" for k in range(4000) if k % 7}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
