"""Lines in packs: of each frame in a file the last line, whatever the order and size of lines; the state has as few partitions as its lines need."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest

from framelake.sources.scratch import shared
from framelake.streaming import ingest

from test_latest import put


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_packs_hold_the_last_line_of_each_frame(monkeypatch, size):
    monkeypatch.setattr(ingest, "PACK", size)
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(-600, 600), "x" if k < 400 else "y", 0 if k % 400 < 250 else 7, f"line {k}") for k in range(900)]
    want = {(f, file, block, i): value for f, i, file, block, value in rows}
    kinds = pa.schema({"flight": pa.string(), "sample_index": pa.int64(), "file": pa.string(), "block": pa.int64(), "value": pa.string(), "written": pa.int64()})
    cut = lambda part: pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*r, 1), strict=True)) for r in part], kinds)
    packs = pa.Table.from_batches(ingest.packed([cut(rows[:0]), cut(rows[:313]), cut(rows[313:])], 4)).to_pylist()
    got = {}
    for p in packs:
        assert p["at"] == 4 and len(p["sample_index"]) == len(p["value"].split("\n")) and {i // ingest.SPAN for i in p["sample_index"]} == {p["span"]}
        got |= {(p["flight"], p["file"], p["block"], i): v for i, v in zip(p["sample_index"], p["value"].split("\n"), strict=True)}
    assert got == want and sum(len(p["sample_index"]) for p in packs) == len(want)
    assert len(packs) == len(want) if size == 1 else len(packs) <= 2 * 6 * 4  # flights, spans, files with their blocks
    assert not list(ingest.packed([], 0)) and not list(ingest.packed([cut([])], 0))


def test_later_packs_of_a_block_win(spark, monkeypatch):
    """A task that ends its packs after every batch of lines, and frames that come again and again."""
    rnd = random.Random(8)
    path, out, check = (shared(spark, x) for x in ("incoming", "latest", "progress"))
    want = {}
    for k in range(3):
        rows = [(rnd.choice("fg"), rnd.randrange(500), f"{k} {n}") for n in range(700)]
        put(path, f"{k}.jsonl", 1_700_000_000 + 100 * k, rows)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        monkeypatch.setattr(ingest, "HELD", 1)
        try:
            ingest.write(ingest.latest_wins(ingest.line_stream(spark, path)), out, check, 3).awaitTermination()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        now = {(f, i): stem for f, i, stem in rows}
        want |= {(f, i, 1 + max((v for (a, b, v) in want if (a, b) == (f, i)), default=0)): stem for (f, i), stem in now.items()}
    assert {(r.flight, r.sample_index, r.version): r.stem for r in spark.read.parquet(out).collect()} == want


def test_state_has_few_partitions(spark, monkeypatch):
    """One for so many bytes of files, and for each core; the session's own number stays."""
    path, out, check = (shared(spark, x) for x in ("incoming", "latest", "progress"))
    put(path, "a.jsonl", 1_700_000_000, [("f", i, "s" * 100) for i in range(500)])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        n = ingest.partitions_for(spark, path)
        assert n == spark.sparkContext.defaultParallelism < 50
        monkeypatch.setattr(ingest, "STATE_BYTES", 5000)
        assert n < ingest.partitions_for(spark, path) < 50
        monkeypatch.setattr(ingest, "STATE_BYTES", 1)
        assert ingest.partitions_for(spark, path) == 50
        query = ingest.write(ingest.latest_wins(ingest.line_stream(spark, path)), out, check, n)
        query.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
        assert {json.loads(p.json)["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress} == {n}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_little_goes_to_python_at_once(spark, monkeypatch):
    """Packs are large rows: batches are cut by bytes, and the session's own number of these stays."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)

    class Stream:
        def __getattr__(self, _):
            return lambda *a, **k: self

        def start(self):
            seen.append(int(spark.conf.get(name)))

    class Frames:
        sparkSession, writeStream = spark, Stream()  # noqa: N815

    ingest.write(Frames(), "out", "check")
    assert seen == [ingest.ARROW_BYTES] and seen[0] <= 8 << 20 and spark.conf.get(name) == before
