"""COCO documents are made of rows by the task that writes them: a document isn't gathered in the JVM."""

from __future__ import annotations

import json

import pyarrow as pa

from framelake.plans import sources
from framelake.sources import lines

SCHEMA = pa.schema([("document", pa.int64()), ("image_id", pa.int64()), ("file_name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("annotation_id", pa.int64()), ("category_id", pa.int64()), ("label", pa.string()), *[(k, pa.float64()) for k in ("x1", "y1", "w", "h")]])


def written(rows, sizes):
    """Documents of rows that come in batches of these sizes, by file."""
    table, at, texts = pa.Table.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA), 0, {}
    batches = []
    for n in sizes:
        batches += table.slice(at, n).combine_chunks().to_batches()
        at += n
    for b in lines.coco_documents(iter(batches)):
        for f, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            texts.setdefault(f, []).append(v)
    return {f: json.loads("\n".join(v)) for f, v in texts.items()}


def test_documents_are_whole_wherever_batches_end():
    name = 'a "b"\\\n.jpg'
    rows = [
        (0, 1, "1.jpg", 9, 8, 10, 2, "L2", 1.5, 0.1, 1e300, -0.0), (0, 1, None, 9, 8, 11, 3, "L3", 1.0, 2.0, 3.0, 4.0), (0, 2, name, 9, 8, 12, 2, "L2", 1.0, 2.0, 3.0, 4.0),
        (5, 7, "é.jpg", None, 8, 13, None, None, None, 2.0, 3.0, 4.0), (None, None, None, 9, 8, None, 1, 'x"', 1.0, 2.0, 3.0, 4.0),
    ]
    whole = written(rows, [5])
    assert all(written(rows, s) == whole for s in ([1] * 5, [2, 3], [3, 2], [4, 1])) and whole.keys() == {"0.json", "5.json", "null.json"}
    first = whole["0.json"]
    assert first["images"] == [{"id": 1, "file_name": "1.jpg", "width": 9, "height": 8}, {"id": 2, "file_name": name, "width": 9, "height": 8}]
    assert [(a["id"], a["image_id"], a["category_id"]) for a in first["annotations"]] == [(10, 1, 2), (11, 1, 3), (12, 2, 2)]
    assert first["annotations"][0]["bbox"] == [1.5, 0.1, 1e300, -0.0] and first["categories"] == [{"id": 2, "name": "L2"}, {"id": 3, "name": "L3"}]
    assert whole["5.json"]["annotations"] == [{"id": 13, "image_id": 7, "category_id": None, "bbox": [None, 2.0, 3.0, 4.0]}]
    assert whole["null.json"]["images"] == [] and whole["null.json"]["categories"] == [{"id": 1, "name": 'x"'}]
    assert list(lines.coco_documents(iter([]))) == []


def test_no_document_is_gathered(spark, sf_dir, monkeypatch):
    plans, write = [], sources.write_lines

    def seen(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path)

    monkeypatch.setattr(sources, "write_lines", seen)
    found = sources._coco(spark, sf_dir, None, sources.WHOLE)
    assert found.count() == sources.table(spark, sf_dir, "lineitem").count()
    assert "Aggregate" not in plans[0] and "collect" not in plans[0]
