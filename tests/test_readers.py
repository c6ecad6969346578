from __future__ import annotations

import json
import zipfile

import pytest

from framelake.sources import annotations as an
from framelake.sources.scratch import shared, write_text


def line(i, **more):
    return json.dumps({"flight": "f", "sample_index": i, "shapes": [], **more})


def folder(spark, chunks, done):
    path = shared(spark, "chunks")
    for (a, z), lines in chunks.items():
        write_text(spark, f"{path}/f_chunk_{a}_{z}.jsonl", "\n".join(lines) + "\n")
        if (a, z) in done:
            write_text(spark, f"{path}/f_chunk_{a}_{z}.done", "")
    return path


def test_last_line_of_the_last_chunk_wins(spark):
    path = folder(spark, {(0, 10): [line(1, stem="a"), line(1, stem="b"), "{bro"], (5, 20): [line(1, stem="c"), line(9)], (100, 110): [line(100)]}, {(0, 10), (5, 20)})
    with pytest.raises(ValueError):
        an.frames(spark, path, "f")
    rows = {r.sample_index: r.stem for r in an.frames(spark, path, "f", partial=True).collect()}
    assert rows == {1: "c", 9: None}
    assert {r.sample_index for r in an.frames(spark, path, "f", 2, 20).collect()} == {9}


def test_missing_scores_and_coarse_labels(spark):
    shapes = [{"label": "x", "points": [[3, 4], [1, 9]]}, {"label": "y", "score": 0.0, "points": [[0, 0], [1, 1]], "attributes": {"coarse": "c"}}]
    path = folder(spark, {(0, 10): [line(1, shapes=shapes), line(2, error="lost")]}, {(0, 10)})
    rows = an.boxes(an.frames(spark, path, "f")).orderBy("pos").collect()
    assert [(r.label, r.coarse, r.score, r.x1, r.y1, r.x2, r.y2) for r in rows] == [("x", "x", 1.0, 1.0, 4.0, 3.0, 9.0), ("y", "c", 0.0, 0.0, 0.0, 1.0, 1.0)]


def test_resume_stops_at_the_first_broken_line(spark):
    path = shared(spark, "resume") + "/a.jsonl"
    write_text(spark, path, "\n".join([line(1), line(2, error="e"), "{bro", line(3)]))
    assert {r.sample_index for r in an.done(an.lines(spark, [path]), False).collect()} == {1, 2}
    assert {r.sample_index for r in an.done(an.lines(spark, [path]), True).collect()} == {1}


def test_sink_stops_before_it_writes(spark):
    path = shared(spark, "sink")
    df = spark.createDataFrame([(k, "e") for k in range(4)], "k long, error string")
    with pytest.raises(Exception, match="more than 3"):
        an.append(df, path, 3)
    an.append(df, path, 4)
    assert spark.read.json(path).count() == 4


def test_unknown_category(spark):
    path = shared(spark, "coco") + "/a.json"
    write_text(spark, path, json.dumps({"images": [{"id": 1, "file_name": "a", "width": 1, "height": 1}], "annotations": [], "categories": [{"id": 1, "name": "a"}]}))
    assert an.coco(spark, path, "a", with_empty=True).count() == 1
    with pytest.raises(ValueError):
        an.coco(spark, path, "b")


def test_files_given_by_name_are_listed_by_folder(spark, tmp_path, monkeypatch):
    """However many files are given, no Spark job lists them, and a file that isn't given stays out."""
    for k in range(100):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps({"flight": "f", "sample_index": k, "stem": "one"}) + "\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.jsonl").write_text("".join(json.dumps({"flight": "f", "sample_index": k, "stem": "two"}) + "\n" for k in (0, 100)))
    monkeypatch.setattr(an, "listing", lambda *_: pytest.fail("a job a path"))
    files = [f"file://{tmp_path}/{k}.jsonl" for k in range(99)]
    read = lambda paths: {r.sample_index: r.stem for r in an.annotations(spark, paths).collect()}
    assert read(files) == dict.fromkeys(range(99), "one")
    assert read([f"{tmp_path}/in", *files]) == dict.fromkeys(range(99), "one") | {100: "two"}
    assert read([*files, f"{tmp_path}/in"]) == dict.fromkeys(range(99), "one") | {0: "two", 100: "two"}
    assert read([str(tmp_path)]) == dict.fromkeys(range(100), "one") | {0: "two", 100: "two"}


def test_contents_of_archives_are_not_shuffled(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s__a.zip", "w") as z:
        z.writestr("n.json", json.dumps({"shapes": [{"label": "l0", "points": [[0, 0], [1, 2]]}]}))
        z.writestr("n.jpg", b"")
    found = an.zipped(spark, str(tmp_path), {"l0": "zero"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = an.zipped(spark, str(tmp_path), {"l0": "zero"})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    assert [tuple(r) for r in found.collect()] == [("s", "n", "zero", 0.0, 0.0, 1.0, 2.0)]
