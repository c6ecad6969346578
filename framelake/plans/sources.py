"""S1-S15, A12, 2.11: what is written in each format and read again must be the rows that it came from."""

from __future__ import annotations

import io
import json
import time
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..registry import query
from ..sources import annotations as an
from ..sources.lines import store, write_lines
from ..sources.scratch import renamed, shared, write_json
from ..streaming import ingest
from .base import BOXES, boxes, table

#: Frames of a chunk file, and images of a COCO document, in two sizes; where chunks have markers, the last stays unfinished.
CHUNK, WHOLE = 700, 1000


def frames_of(spark, sf_dir, block: int | None = None):
    """Frames as JSON rows: a box a shape, some without score, each frame at its order key; with block as in boxes()."""
    b = boxes(spark, sf_dir, block)
    keys = ["frame"] if block is None else ["block", "frame"]
    p = lambda x, y: F.array(F.col(x), F.col(y))
    score = F.when(F.col("pos") % 4 != 3, F.col("score"))
    shape = F.struct("pos", "label", score.alias("score"), F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2")).alias("points"), F.lit("rectangle").alias("shape_type"))
    # boxes of one frame, which lie side by side: a window over them takes them as they lie, an aggregate would sort them again
    shapes = F.sort_array(F.collect_list(shape).over(Window.partitionBy(*keys))).alias("shapes")
    rows = b.select(*keys, "pos", shapes).where("pos = 0")
    return rows.select(*keys[:-1], F.lit("f").alias("flight"), F.col("frame").alias("sample_index"), (F.col("frame") / 30).alias("dts_s"), (F.col("frame") * 1000).alias("dts_ticks"), ((F.col("frame") + 1) * 1_000_000).alias("utc_us"), F.lit(256).alias("width"), F.lit(224).alias("height"), "shapes")


def chunks_of(spark, sf_dir, size: int = CHUNK, open_last: bool = True) -> str:
    """A folder with chunk files of all frames and their markers, named and written by tasks: a stale line before each frame's own, broken lines, a marker for all but the last chunk (or for all)."""
    path, rows = shared(spark, "chunks"), frames_of(spark, sf_dir, size)
    own = F.to_json(F.struct("flight", "sample_index", "dts_s", "dts_ticks", "utc_us", "width", "height", "shapes"))
    stale = F.format_string('{"flight":"f","sample_index":%d,"shapes":[]}', "sample_index")
    chunk = (F.floor(F.col("sample_index") / size) * size).alias("c")
    name = lambda kind: F.concat(F.lit("f_chunk_"), "c", F.lit("_"), F.col("c") + size, F.lit(kind)).alias("file")
    text = rows.select(F.col("block").alias("c"), F.concat_ws("\n", stale, own, F.lit('{"flight":"f","sample_i')).alias("value")).sortWithinPartitions("c").select(name(".jsonl"), "value")
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_index")).select(chunk)
    last = F.broadcast(ids.agg(F.max("c").alias("last")))  # one row
    done = ids.distinct().join(last, F.col("c") < F.col("last") + (0 if open_last else 1)).select(name(".done"), F.lit(None).cast("string").alias("value"))
    write_lines(text.unionByName(done), path)  # a chunk's frames are made in one task, so texts aren't moved
    return path


def lines_sql(size: int) -> str:
    return f"WITH {BOXES}, n AS (SELECT frame // {size} * {size} AS c, count(DISTINCT frame) AS n FROM boxes GROUP BY c), z AS (SELECT max(c) AS z FROM n)"


LINES = lines_sql(CHUNK)


@query("s1_chunk_files", f"{LINES} SELECT 'f' AS flight, c AS \"start\", c + {CHUNK} AS \"end\", c < z AS done FROM n, z")
def s1(spark, sf_dir):
    return an.chunk_files(spark, chunks_of(spark, sf_dir)).select("flight", "start", "end", F.coalesce("done", F.lit(False)).alias("done"))


@query("s2_lines", f"{LINES} SELECT c AS \"start\", 3 * n AS lines FROM n")
def s2(spark, sf_dir):
    return _lines(spark, chunks_of(spark, sf_dir))


def _lines(spark, path):
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    found = an.chunk_files(spark, path).select(name, "start")  # a row a file
    # the folder is read as one, so that Spark doesn't look for each file
    rows = an.lines(spark, [path]).select(name).join(F.broadcast(found), "name")
    return rows.groupBy("start").agg(F.count(F.lit(1)).alias("lines"))


@query("s3_frames", f"WITH {BOXES} SELECT frame, pos, label, CASE WHEN pos % 4 = 3 THEN 1.0 ELSE score END AS score, x1, y1, x2, y2 FROM boxes WHERE frame >= 20 AND frame < (SELECT max(frame) // {CHUNK} * {CHUNK} FROM boxes)")
def s3(spark, sf_dir):
    return _frames(an.frames(spark, chunks_of(spark, sf_dir), "f", 20, partial=True))


def _frames(found):
    return an.boxes(found).select(F.col("sample_index").alias("frame"), F.col("pos").cast("long").alias("pos"), "label", "score", "x1", "y1", "x2", "y2")


@query("s4_annotations_mixed", f"WITH {BOXES} SELECT frame, pos, label, CASE WHEN pos % 4 = 3 THEN 1.0 ELSE score END AS score, x1, y1, x2, y2 FROM boxes")
def s4(spark, sf_dir):
    """A folder with old lines of all frames, then a folder and some files that between them have the true ones."""
    rows, text = frames_of(spark, sf_dir), F.to_json(F.struct("flight", "sample_index", "width", "height", "shapes"))
    old, even, odd = (shared(spark, x) for x in ("old", "even", "odd"))
    rows.select(F.format_string('{"flight":"f","sample_index":%d,"shapes":[{"label":"old","points":[[0,0],[1,1]]}]}', "sample_index")).write.text(f"{old}/raw")
    rows.where("sample_index % 2 = 0").select(text).write.text(f"{even}/raw")
    block = F.concat(F.lit("odd_"), F.floor(F.col("sample_index") / CHUNK), F.lit(".jsonl"))
    write_lines(rows.where("sample_index % 2 = 1").select(block.alias("file"), text.alias("value")).repartition("file").sortWithinPartitions("file"), odd)
    files = [path for path, _, _ in an.listed(spark, odd)]
    for folder in (old, even):
        renamed(spark, f"{folder}/raw", folder, ".jsonl")
    return _frames(an.annotations(spark, [old, even, *files]))


@query(
    "s5_resume_scan",
    """WITH e AS (SELECT event_id, user_id % 8 AS f, CASE WHEN event_type = 'error' THEN 'lost' ELSE '' END AS error FROM events), s AS (SELECT f, min(event_id) AS stop FROM e WHERE event_id % 1000 = 777 GROUP BY f)
SELECT event_id AS sample_index, error FROM e LEFT JOIN s USING (f) WHERE stop IS NULL OR event_id < stop""",
)
def s5(spark, sf_dir):
    """What eight interrupted runs have done: the events of each as lines in their order, some of them broken."""
    path, e = shared(spark, "resume"), table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("sample_index"), F.when(F.col("event_type") == "error", "lost").alias("error")))
    rows = e.select(F.format_string("run_%d.jsonl", F.col("user_id") % 8).alias("file"), "event_id", F.when(F.col("event_id") % 1000 == 777, F.lit('{"sample_ind')).otherwise(line).alias("value"))
    write_lines(rows.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value"), path)
    return an.done(an.lines(spark, [path]), retry_errors=False)


@query("s6_sample_index", "SELECT event_id AS sample_index, round(user_id * 1001 / 30000.0::DOUBLE, 9) AS t, event_type AS mode FROM events WHERE event_id % 5 <> 0 AND event_id % 2 = 0")
def s6(spark, sf_dir):
    path = shared(spark, "index")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_index"), (F.col("user_id") * 1001).alias("dts_ticks"), F.lit(30000).alias("timescale"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("stream"), (F.col("event_id") % 5 != 0).cast("int").alias("valid"), F.col("event_type").alias("mode"))
    e.write.option("header", "true").csv(path)
    return an.index(spark, path, "a").select("sample_index", F.round("t", 9).alias("t"), "mode")


@query("s7_newest_file", "SELECT o_orderstatus AS name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def s7(spark, sf_dir):
    """Result sets of orders by status, written in part, then whole under names that come first: the newest file of each counts."""
    path, orders = shared(spark, "sets"), table(spark, sf_dir, "orders")
    for k, (version, rows) in enumerate((("b", orders.where("o_orderkey % 2 = 0")), ("a", orders))):
        if k:
            time.sleep(1.1)  # file times may be whole seconds
        lines = rows.select(F.concat("o_orderstatus", F.lit(f"__{version}.jsonl")).alias("file"), F.to_json(F.struct("o_orderstatus", "o_totalprice")).alias("value"))
        write_lines(lines.repartition("file").sortWithinPartitions("file"), path)
    files = an.listing(spark, path).withColumn("name", F.regexp_extract("path", r"([^/]+)__[ab]\.jsonl$", 1))
    found = [r.path for r in an.newest(files, ["name"]).collect()]  # a row a set
    return spark.read.schema("o_orderstatus string, o_totalprice double").json(found).groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s8_coco_category", f"WITH {BOXES} SELECT frame AS image_id, frame * 100 + pos AS annotation_id, label, x1, y1, x2, y2 FROM boxes WHERE label = 'L2'")
def s8(spark, sf_dir):
    return _coco(spark, sf_dir, "L2").select("image_id", "annotation_id", "label", "x1", "y1", "x2", "y2")


@query("s11_coco_all", f"WITH {BOXES} SELECT frame AS image_id, frame * 100 + pos AS annotation_id, label, x1, y1, x2, y2 FROM boxes")
def s11(spark, sf_dir):
    return _coco(spark, sf_dir, None).select("image_id", "annotation_id", "label", "x1", "y1", "x2", "y2")


def _coco(spark, sf_dir, category, size: int = CHUNK):
    """All images, `size` of them a COCO document (a file each, written by executors), read back."""
    # a document's boxes lie in one task, frame by frame, so they are neither moved nor gathered again
    first = F.when(F.col("pos") == 0, F.concat(F.col("frame").cast("string"), F.lit(".jpg")))
    size_of = (F.lit(256).alias("width"), F.lit(224).alias("height"))
    mark = ((F.col("frame") * 100 + F.col("pos")).alias("annotation_id"), F.substring("label", 2, 9).cast("long").alias("category_id"), "label", "x1", "y1", bx.width().alias("w"), bx.height().alias("h"))
    path = shared(spark, "coco")
    write_lines(boxes(spark, sf_dir, size).select(F.col("block").alias("document"), F.col("frame").alias("image_id"), first.alias("file_name"), *size_of, *mark), path)
    return an.coco(spark, path, category)


@query("s9_tracking_truth", f"WITH {BOXES} SELECT frame, pos, track AS target, x1, y1, x2, y2 FROM boxes WHERE pos % 3 <> 1")
def s9(spark, sf_dir):
    return _tracking(spark, boxes(spark, sf_dir))


def _tracking(spark, b):
    p = lambda x, y: F.array(F.col(x), F.col(y))
    tag = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    tags = F.when(F.col("pos") % 3 == 1, F.array(tag("other", F.lit("1")))).otherwise(F.array(tag("other", F.lit("1")), tag("target id", F.col("track").cast("string"))))
    o = F.struct("pos", F.struct(F.array(p("x2", "y2"), p("x1", "y1")).alias("exterior")).alias("points"), tags.alias("tags"))
    path = shared(spark, "tracking")
    b.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("pos", o.alias("o")))).alias("l")).select("frame", F.transform("l", lambda x: x["o"]).alias("objects")).write.json(path)
    return an.tracking_truth(spark, path).withColumn("pos", F.col("pos").cast("long"))


ZIPPED = {"l0": "zero", "l1": "one", "l2": "two"}


@query(
    "s10_zipped_labels",
    f"""WITH {BOXES} SELECT 's' || CAST(frame // 500 AS VARCHAR) AS sequence, 'n' || CAST(frame AS VARCHAR) AS name, CASE label WHEN 'L0' THEN 'zero' WHEN 'L1' THEN 'one' ELSE 'two' END AS label, x1, y1, x2, y2
FROM boxes WHERE frame % 4 <> 3 AND label IN ('L0', 'L1', 'L2')""",
)
def s10(spark, sf_dir):
    """Archives of 500 frames each, written by tasks: the first of two of a sequence counts, frames without an image and labels that the map lacks don't."""
    path = shared(spark, "zips")

    def archive(rows: pd.DataFrame) -> pd.DataFrame:
        fs, root = store(path)
        fs.create_dir(root)
        sequence = f"s{rows['sequence'].iloc[0]}"
        rows = rows.sort_values("frame", kind="stable")
        frames = rows["frame"].to_numpy()
        heads = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])).tolist()
        boxes_ = list(zip(*(rows[c].tolist() for c in ("label", "x1", "y1", "x2", "y2")), strict=True))
        for version in ("a", "b"):
            whole, more = io.BytesIO(), version == "b"
            with zipfile.ZipFile(whole, "w") as z:
                for at, to in zip(heads, [*heads[1:], len(frames)], strict=True):
                    shapes = [{"label": f" {label}", "points": [[x1, y1], [x2 + more, y2]]} for label, x1, y1, x2, y2 in boxes_[at:to]]
                    z.writestr(zipfile.ZipInfo(f"n{frames[at]}.json"), json.dumps({"shapes": shapes}))
                    if frames[at] % 4 != 3:
                        z.writestr(zipfile.ZipInfo(f"n{frames[at]}.jpg"), b"")
            with fs.open_output_stream(f"{root}/{sequence}__{version}.zip") as out:
                out.write(whole.getvalue())
        return pd.DataFrame({"sequence": [sequence], "boxes": [len(rows)]})

    rows = boxes(spark, sf_dir).select(F.floor(F.col("frame") / 500).alias("sequence"), "frame", "label", "x1", "y1", "x2", "y2")
    rows.groupBy("sequence").applyInPandas(archive, "sequence string, boxes long").write.format("noop").mode("overwrite").save()
    return an.zipped(spark, path, ZIPPED)


@query("s13_append_sink", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def s13(spark, sf_dir):
    path, e = shared(spark, "sink"), table(spark, sf_dir, "events").select("user_id", "event_id", F.lit(None).cast("string").alias("error"))
    an.append(e.where("event_id % 2 = 0"), path, 0)
    an.append(e.where("event_id % 2 = 1"), path, 0)
    return spark.read.schema("user_id long, event_id long").json(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("s14_atomic_sink", f"WITH {BOXES} SELECT label, count(*) AS n FROM boxes GROUP BY label")
def s14(spark, sf_dir):
    """A small summary, written twice: whoever reads it meets one of the two whole."""
    path = shared(spark, "summary") + "/summary.json"
    found = boxes(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()  # a row a label
    write_json(spark, path, [{"label": "none", "n": 0}])
    write_json(spark, path, [r.asDict() for r in found])
    return spark.read.schema("label string, n long").json(path)


COCO_OUT = f"""WITH {BOXES}, l AS (SELECT *, CASE WHEN score >= 0.05 THEN 'keep' WHEN score >= 0.02 THEN 'ignore' ELSE 'drop' END AS level, substr(label, 2)::INTEGER + 1 AS cat FROM boxes),
i AS (SELECT frame, row_number() OVER (ORDER BY frame) AS id FROM (SELECT DISTINCT frame FROM boxes)), k AS (SELECT unnest(range(1, 7)) AS c),
a AS (SELECT i.id AS image_id, pos, CAST(c AS INTEGER) AS category_id, (x2 - x1) * (y2 - y1) AS area, CAST(level <> 'keep' AS INTEGER) AS iscrowd
  FROM l JOIN i USING (frame) JOIN k ON c = cat OR (cat = 7 AND level <> 'keep') WHERE level <> 'drop')
SELECT row_number() OVER (ORDER BY image_id, pos, category_id) AS id, image_id, category_id, round(area, 1) AS area, iscrowd FROM a"""


@query("s15_coco_writer", COCO_OUT)
def s15(spark, sf_dir):
    level = F.when(F.col("score") >= 0.05, "keep").when(F.col("score") >= 0.02, "ignore").otherwise("drop")
    _, marks = an.to_coco(boxes(spark, sf_dir).withColumn("level", level), shared(spark, "coco-out"), [f"L{k}" for k in range(6)], ["frame"])
    return marks.select("id", "image_id", "category_id", "area", "iscrowd")


@query("a12_chunk_progress", f"{LINES} SELECT 'f' AS flight, count(*) AS chunks, count(*) FILTER (WHERE c < z) AS done, count(*) FILTER (WHERE c = z) AS \"open\", CAST(sum(3 * n) AS BIGINT) AS lines FROM n, z")
def a12(spark, sf_dir):
    return an.chunk_progress(spark, chunks_of(spark, sf_dir))


# The same in files of another size, with a marker for every chunk where frames are read.
EVERY = lines_sql(WHOLE)


@query("s1_chunk_files_whole", f"{EVERY} SELECT 'f' AS flight, c AS \"start\", c + {WHOLE} AS \"end\", c < z AS done FROM n, z")
def s1_whole(spark, sf_dir):
    return an.chunk_files(spark, chunks_of(spark, sf_dir, WHOLE)).select("flight", "start", "end", F.coalesce("done", F.lit(False)).alias("done"))


@query("s2_lines_whole", f"{EVERY} SELECT c AS \"start\", 3 * n AS lines FROM n")
def s2_whole(spark, sf_dir):
    return _lines(spark, chunks_of(spark, sf_dir, WHOLE))


@query("s3_frames_whole", f"WITH {BOXES} SELECT frame, pos, label, CASE WHEN pos % 4 = 3 THEN 1.0 ELSE score END AS score, x1, y1, x2, y2 FROM boxes")
def s3_whole(spark, sf_dir):
    return _frames(an.frames(spark, chunks_of(spark, sf_dir, WHOLE, open_last=False), "f"))


@query("a12_chunk_progress_whole", f"{EVERY} SELECT 'f' AS flight, count(*) AS chunks, count(*) FILTER (WHERE c < z) AS done, count(*) FILTER (WHERE c = z) AS \"open\", CAST(sum(3 * n) AS BIGINT) AS lines FROM n, z")
def a12_whole(spark, sf_dir):
    return an.chunk_progress(spark, chunks_of(spark, sf_dir, WHOLE))


@query("s8_coco_category_whole", f"WITH {BOXES} SELECT frame AS image_id, frame * 100 + pos AS annotation_id, label, x1, y1, x2, y2 FROM boxes WHERE label = 'L2'")
def s8_whole(spark, sf_dir):
    return _coco(spark, sf_dir, "L2", WHOLE).select("image_id", "annotation_id", "label", "x1", "y1", "x2", "y2")


@query("s11_coco_all_whole", f"WITH {BOXES} SELECT frame AS image_id, frame * 100 + pos AS annotation_id, label, x1, y1, x2, y2 FROM boxes")
def s11_whole(spark, sf_dir):
    return _coco(spark, sf_dir, None, WHOLE).select("image_id", "annotation_id", "label", "x1", "y1", "x2", "y2")


@query("s9_tracking_truth_whole", f"WITH {BOXES} SELECT frame, pos, track AS target, x1, y1, x2, y2 FROM boxes WHERE pos % 3 <> 1")
def s9_whole(spark, sf_dir):
    return _tracking(spark, boxes(spark, sf_dir))


@query("i1_incremental_ingestion", f"WITH {BOXES} SELECT frame AS sample_index, count(*) AS n FROM boxes GROUP BY frame")
def i1(spark, sf_dir):
    """Frames through the file source, a first part and then the rest, each frame once."""
    path, out, check = (shared(spark, x) for x in ("incoming", "ingested", "progress"))
    f = frames_of(spark, sf_dir)
    for part in (0, 1):
        f.where(F.col("sample_index") % 2 == part).write.mode("append").option("compression", "gzip").json(path)
        ingest.write(ingest.once_each(ingest.frame_stream(spark, path), late="1000 days"), out, check).awaitTermination()
    return spark.read.parquet(out).select("sample_index", F.size("shapes").cast("long").alias("n"))


@query("i3_latest_wins", f"WITH {BOXES} SELECT frame AS sample_index, count(*) AS n, CASE WHEN frame % 3 = 0 THEN 2 ELSE 1 END AS versions FROM boxes GROUP BY frame")
def i3(spark, sf_dir):
    """Frames through the file source in two batches, the second of which corrects a third of the first; the second is read after a restart."""
    path, out, check = (shared(spark, x) for x in ("incoming", "ingested", "progress"))
    f = frames_of(spark, sf_dir, ingest.SPAN).drop("block")  # as recorded: neighbouring frames lie together
    late = F.col("sample_index") % 3 == 0
    stale = f.withColumn("shapes", F.when(late, F.filter("shapes", lambda s: F.lit(False))).otherwise(F.col("shapes")))
    for part in (stale, f.where(late)):
        part.write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)
        ingest.write(ingest.latest_wins(ingest.line_stream(spark, path)), out, check, ingest.partitions_for(spark, path)).awaitTermination()
    found = spark.read.parquet(out).groupBy("sample_index").agg(F.max_by(F.size("shapes"), "version").cast("long").alias("n"), F.max("version").alias("versions"))
    return found.select("sample_index", "n", "versions")


@query(
    "i2_windowed_counts",
    f"""WITH {BOXES}, f AS (SELECT frame + 1 AS s, count(*) AS n FROM boxes GROUP BY frame)
SELECT s // 60 * 60 AS "start", 'f' AS flight, count(*) AS frames, CAST(sum(n) AS BIGINT) AS boxes FROM f GROUP BY s // 60 HAVING s // 60 * 60 + 60 <= (SELECT max(s) FROM f) - 30""",
)
def i2(spark, sf_dir):
    """Frames and boxes by minute, as windows close."""
    path, out, check = (shared(spark, x) for x in ("incoming", "windows", "progress"))
    frames_of(spark, sf_dir).write.option("compression", "gzip").json(path)
    ingest.write(ingest.counts_by_window(ingest.frame_stream(spark, path), "60 seconds", "30 seconds"), out, check).awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.unix_seconds("start"))
