"""Latest wins in a stream: corrections, late lines, and a restart from the checkpoint."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from framelake.sources.scratch import shared
from framelake.streaming import ingest


def put(path, name, when, rows):
    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.writelines(json.dumps({"flight": fl, "sample_index": i, "stem": s}) + "\n" for fl, i, s in rows)
        f.write("{bro\n")
    os.utime(f"{folder}/{name}", (when, when))


def test_later_lines_win_over_batches_and_restarts(spark):
    path, out, check = (shared(spark, x) for x in ("incoming", "latest", "progress"))
    steps = [
        ("b.jsonl", 1_700_000_000, [("f", 1, "one"), ("f", 2, "two"), ("f", 1, "one again"), ("g", 1, "other flight")]),
        ("c.jsonl", 1_700_000_100, [("f", 1, "corrected"), ("f", 3, "three")]),
        ("a.jsonl", 1_600_000_000, [("f", 1, "late"), ("f", 4, "four")]),
    ]
    for step in steps:
        put(path, *step)
        query = ingest.write(ingest.latest_wins(ingest.line_stream(spark, path)), out, check)
        query.awaitTermination()
        assert query.exception() is None
    found = sorted((r.flight, r.sample_index, r.version, r.stem) for r in spark.read.parquet(out).collect())
    assert found == [("f", 1, 1, "one again"), ("f", 1, 2, "corrected"), ("f", 2, 1, "two"), ("f", 3, 1, "three"), ("f", 4, 1, "four"), ("g", 1, 1, "other flight")]
    last = spark.read.parquet(out).groupBy("flight", "sample_index").agg(F.max_by("stem", "version").alias("stem")).where("flight = 'f' and sample_index = 1").first()
    assert last.stem == "corrected"


def test_state_goes_by_a_timer(spark):
    """A frame whose state is gone counts from 1 again."""
    path, out, check = (shared(spark, x) for x in ("incoming", "latest", "progress"))
    for k in range(3):
        put(path, f"{k}.jsonl", 1_700_000_000 + 100 * k, [("f", 1 if k != 1 else 2, str(k))])
        ingest.write(ingest.latest_wins(ingest.line_stream(spark, path), "50 seconds"), out, check).awaitTermination()
    assert sorted((r.sample_index, r.version, r.stem) for r in spark.read.parquet(out).collect()) == [(1, 1, "0"), (1, 1, "2"), (2, 1, "1")]


def test_neighbouring_frames_share_a_call_of_the_store(spark, tmp_path, monkeypatch):
    """1,000 frames, some of them corrected, in a few calls; what is known of each frame is its own."""
    calls = tmp_path / "calls"

    class Counted(ingest.Latest):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            with open(calls, "a") as f:
                f.write("x\n")
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(ingest, "Latest", Counted)
    path, out, check = (shared(spark, x) for x in ("incoming", "latest", "progress"))
    for name, when, step in (("a.jsonl", 1_700_000_000, 1), ("b.jsonl", 1_700_000_100, 3), ("0.jsonl", 1_700_000_050, 2)):
        put(path, name, when, [("f", i, name) for i in range(-10, 990, step)])
        ingest.write(ingest.latest_wins(ingest.line_stream(spark, path)), out, check).awaitTermination()
    found = {(r.sample_index, r.version): r.stem for r in spark.read.parquet(out).collect()}
    expected = {(i, 1): "a.jsonl" for i in range(-10, 990)} | {(i, 2): "b.jsonl" for i in range(-10, 990, 3)}
    expected |= {(i, 2): "0.jsonl" for i in range(-10, 990, 2) if (i + 10) % 3}
    assert found == expected
    assert len(calls.read_text().split()) <= 20
