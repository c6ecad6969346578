"""What is written and read again is the whole table, by executors."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framelake import registry
from framelake.plans.base import table
from framelake.plans.sources import WHOLE
from framelake.sources import annotations as an
from framelake.sources.scratch import shared, write_text


def test_ids_count_in_their_own_coco_document(spark):
    path = shared(spark, "coco")
    for k, name in enumerate(("a", "b")):
        doc = {"images": [{"id": 1, "file_name": name, "width": 9, "height": 9}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [k, 0, 1, 1]}], "categories": [{"id": 1, "name": name}]}
        write_text(spark, f"{path}/{name}.json", json.dumps(doc))
    assert sorted((r.file_name, r.label, r.x1) for r in an.coco(spark, path).collect()) == [("a", "a", 0.0), ("b", "b", 1.0)]
    assert [r.file_name for r in an.coco(spark, path, "b").collect()] == ["b"]


@pytest.mark.parametrize("name", ["s3_frames_whole", "s11_coco_all_whole"])
def test_every_row_comes_back(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() == table(spark, sf_dir, "lineitem").count()


def test_every_frame_is_in_a_chunk(spark, sf_dir):
    frames = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    chunks = frames.select(F.floor(F.col("l_orderkey") / WHOLE)).distinct().count()
    found = registry.queries()["a12_chunk_progress_whole"](spark, sf_dir).first()
    assert chunks > 1 and (found.chunks, found.done, found.open, found.lines) == (chunks, chunks - 1, 1, 3 * frames.count())
