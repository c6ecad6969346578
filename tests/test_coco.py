"""COCO documents: written as files of one folder, read once, each by itself."""

from __future__ import annotations

import json

from framelake.plans import sources
from framelake.sources import annotations as an


def document(tmp_path, name, images, marks, kinds):
    doc = {"images": [{"id": i, "file_name": f, "width": 9, "height": 8} for i, f in images], "categories": [{"id": i, "name": n} for i, n in kinds]}
    (tmp_path / f"{name}.json").write_text(json.dumps(doc | {"annotations": [{"id": i, "image_id": image, "category_id": kind, "bbox": [i, 1, 2, 3]} for i, image, kind in marks]}))


def test_parts_of_a_document_meet_without_a_shuffle(spark, tmp_path):
    """Ids that repeat in a document match each time; those without a partner, or null, don't."""
    document(tmp_path, "a", [(1, "x"), (1, "y"), (2, "z"), (None, "n")], [(1, 1, 1), (2, 2, 5), (3, 9, 1), (4, None, 1), (5, 2, None), (6, 2, 2)], [(1, "a"), (2, "b"), (2, "c"), (None, "d")])
    document(tmp_path, "b", [(1, "x")], [], [(1, "a")])
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 2, "file_name": "w", "width": 9, "height": 8}]}))
    rows = lambda *a: sorted(((r.image_id, r.file_name, r.width, r.height, r.annotation_id, r.label, r.x1, r.y1, r.x2, r.y2) for r in an.coco(spark, str(tmp_path), *a).collect()), key=str)
    found = [(1, f, 9, 8, 1, "a", 1.0, 1.0, 3.0, 4.0) for f in "xy"] + [(2, "z", 9, 8, 6, label, 6.0, 1.0, 8.0, 4.0) for label in "bc"]
    alone = lambda i, f: (i, f, 9, 8, *[None] * 6)
    assert rows() == found
    assert rows("c") == found[3:]
    assert rows(None, True) == sorted([*found, alone(None, "n"), alone(1, "x"), alone(2, "w")], key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = an.coco(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and plan.count("Scan json") == 1


def test_documents_are_files_of_one_folder(spark, sf_dir, monkeypatch):
    """No folder a document, which Spark would list one by one; boxes are dealt once."""
    plans, paths, write = [], [], sources.write_lines

    def seen(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        paths.append(path)
        write(df, path)

    monkeypatch.setattr(sources, "write_lines", seen)
    n = sources._coco(spark, sf_dir, None).count()
    files = [f.rpartition("/")[0] for f, _, _ in an.listed(spark, paths[0])]
    assert n == sources.table(spark, sf_dir, "lineitem").count() and len(files) > 1 and len(set(files)) == 1
    assert plans[0].count("Exchange") == 1
