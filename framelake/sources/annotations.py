"""Readers and writers of annotation data: frame chunks (JSON lines, plain or zstd), indexes (CSV), COCO, tracking truth, zipped labels.

All readers have fixed schemas, keep unparsable lines out by a corrupt-record column, and carry the line order of a file
where a rule needs it. Files are found by Spark, so any store that it reads will do.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as bx
from . import lines as source_lines

INDEX = "sample_index string, dts_ticks string, timescale string, stream string, valid string, mode string"
COCO = "images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<id: long, image_id: long, category_id: long, bbox: array<double>>>, categories array<struct<id: long, name: string>>"
TRACKS = "frame long, objects array<struct<points: struct<exterior: array<array<double>>>, tags: array<struct<name: string, value: string>>>>"
RUN = "run string, images array<struct<file_name: string, width: int, height: int, gt: array<struct<box: array<double>>>, pred: array<struct<box: array<double>, score: double, label: string>>>>"
FRAME = (
    "flight string, sample_index long, dts_s double, dts_ticks long, stem string, utc_us long, width int, height int, "
    "shapes array<struct<label: string, score: double, points: array<array<double>>, group_id: long, description: string, difficult: boolean, shape_type: string, "
    "flags: map<string,string>, attributes: struct<source: string, prompt: string, coarse: string, uncertain: boolean>, kie_linking: array<array<long>>>>, t_inf_s double, error string"
)
#: Files given by name of one folder from which on the folder is listed instead of each of them.
FEW = 32
JSON_LINES = re.compile(r"\.jsonl(\.zst)?$")
CHUNK = r"([^/]+)_chunk_(\d+)_(\d+)\.(jsonl|jsonl\.zst|done)$"


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """path, modified (ms), length of the files under a folder (or of a file), empty ones too (which Spark's own readers leave out). Names are listed by the driver, as for any read; local ones in one call."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() == "file":
        fs, root = pa.fs.LocalFileSystem(), p.toUri().getPath()
        own = fs.get_file_info(root)
        files = [own] if own.is_file else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        return [(f"file:{f.path}", f.mtime_ns // 1_000_000, f.size) for f in files if f.is_file]
    found, rows = store.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return rows


def listing(spark: SparkSession, path: str) -> DataFrame:
    """What listed() finds, as a table."""
    return spark.createDataFrame(listed(spark, path), "path string, modified long, length long")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """flight, start, end, path, done: a chunk's file (compressed rather than plain) and whether its marker exists."""
    part = lambda k: F.regexp_extract("path", CHUNK, k)
    files = listing(spark, path).where(F.col("path").rlike(CHUNK)).select("path", part(1).alias("flight"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"), part(4).alias("kind"))
    data = F.when(F.col("kind") != "done", F.struct((F.col("kind") == "jsonl.zst").alias("zst"), "path"))
    return files.groupBy("flight", "start", "end").agg(F.max(data)["path"].alias("path"), F.max((F.col("kind") == "done").cast("int")).cast("boolean").alias("done")).where("path is not null")


def newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the file modified last (of equals the last by name)."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line (its place in the file, from 0), value; empty lines are left out. Plain or zstd text.

    Plain files are read in blocks by as many tasks as they need, lines are numbered as they are read (a block's lines lie in one task, one after
    the other), and a block's first number comes from the lines of the blocks before it. Texts aren't shuffled.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    heads = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(heads.select("path", "block", (before - F.col("first")).alias("shift")))  # a row a block
    return rows.join(shift, ["path", "block"]).where("value <> ''").select("path", (F.col("at") + F.col("shift")).cast("int").alias("line"), "value")


def in_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, place (ascending in a file, with gaps), value of files of JSON lines and folders of such: for rules that ask which of two lines is later, without numbering them."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").text(paths).select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"), "value")


def frames(spark: SparkSession, path: str, flight: str, start: int | None = None, end: int | None = None, partial: bool = False) -> DataFrame:
    """Frames of [start, end): the last line of each sample_index wins, broken lines are left out. An unfinished chunk is an error, or (partial) left out.

    Read by a source of our own (sources/lines.py), which doesn't open files that don't meet the range.
    """
    meets = lambda c: c.flight == flight and (start is None or c.end > start) and (end is None or c.start < end)
    found = [c for c in source_lines.listed(path) if meets(c)]
    if (open_ := [c.path for c in found if not c.done]) and not partial:
        raise ValueError(f"chunks not finished: {open_}")
    if len(open_) == len(found):
        raise ValueError(f"no finished chunks of {flight}")
    raw = source_lines.chunks(spark, path, flight, start, end, partial).select(F.struct("start", "path").alias("file"), F.struct("block", "line").alias("place"), "value")
    return _latest_frames(raw, F.col("file"), start, end)


def annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Frames of JSON-lines files and of folders of such files, mixed: the later of two given paths wins, in a folder the later by name, in a file the later line."""
    # names are compared without their schemes, which Spark and Hadoop write differently
    bare = lambda p: re.sub("^[a-z0-9]+:/+", "/", p)
    folders: dict[str, dict[str, str]] = {}

    def under(folder: str) -> dict[str, str]:
        """Files of JSON lines under a folder, by bare name; each folder is listed once."""
        if folder not in folders:
            folders[folder] = {bare(f): f for f, _, _ in listed(spark, folder) if JSON_LINES.search(f)}
        return folders[folder]

    given: dict[str, int] = {}
    beside = Counter(p.rpartition("/")[0] for p in paths if JSON_LINES.search(p))
    for k, p in enumerate(paths):
        if beside[p.rpartition("/")[0]] > FEW and JSON_LINES.search(p) and bare(p) in under(p.rpartition("/")[0]):
            given[bare(p)] = k
        else:
            given |= dict.fromkeys(under(p.rstrip("/")), k)
    if not given:
        raise ValueError(f"no files of JSON lines in {paths}")
    # a folder of which all files are asked for is read as one, so that Spark doesn't look for each of them
    whole = [f for f, found in folders.items() if found and found.keys() <= given.keys() and not any(re.search("/[._]", x[len(bare(f)) :]) for x in found)]
    inside = {x for f in whole for x in folders[f]}
    names = {x: f for found in folders.values() for x, f in found.items()}
    order = spark.createDataFrame(list(given.items()), "bare string, given int")
    raw = in_order(spark, _outermost(whole) + sorted(names[x] for x in given.keys() - inside))
    raw = raw.join(F.broadcast(order), F.regexp_replace("path", "^[a-z0-9]+:/+", "/") == F.col("bare"))  # a row a file
    return _latest_frames(raw, F.struct("given", "path"))


def _outermost(folders: list[str]) -> list[str]:
    """Those that lie in no other."""
    kept: list[str] = []
    for f in sorted(folders, key=lambda f: f"{f}/"):
        if not kept or not f"{f}/".startswith(f"{kept[-1]}/"):
            kept.append(f)
    return kept


def _latest_frames(raw: DataFrame, file: Column, start: int | None = None, end: int | None = None) -> DataFrame:
    parsed = raw.select(file.alias("file"), "place", F.from_json("value", FRAME).alias("f")).where("f.sample_index is not null")
    if start is not None:
        parsed = parsed.where(F.col("f.sample_index") >= start)
    if end is not None:
        parsed = parsed.where(F.col("f.sample_index") < end)
    return parsed.groupBy("f.sample_index").agg(F.max_by("f", F.struct("file", "place")).alias("f")).select("f.*")


def boxes(frame: DataFrame) -> DataFrame:
    """A row for each shape of frames without error: frame columns, pos, label, coarse (else label), score (missing: 1.0), group_id, x1..y2."""
    rows = frame.where("error is null").select("flight", "sample_index", "dts_s", "dts_ticks", "width", "height", F.posexplode("shapes").alias("pos", "s"))
    return rows.select(
        "flight", "sample_index", "dts_s", "dts_ticks", "width", "height", "pos", "s.label", F.coalesce("s.attributes.coarse", "s.label").alias("coarse"),
        F.coalesce("s.score", F.lit(1.0)).alias("score"), "s.group_id", *bx.bbox(F.col("s.points")),
    )


def done(raw: DataFrame, retry_errors: bool) -> DataFrame:
    """sample_index, error ('' if none) of what a resumed run needn't do again. raw: from lines(); of each file only lines before the first unparsable one count."""
    parsed = raw.withColumn("f", F.from_json("value", "sample_index long, error string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    parsed = parsed.withColumn("bad", F.col("f._corrupt").isNotNull() | F.col("f").isNull())
    first = parsed.where("bad").groupBy("path").agg(F.min("line").alias("stop"))  # a row a file at most
    good = parsed.join(first, "path", "left").where("stop is null or line < stop").where("f.sample_index is not null")
    if retry_errors:
        good = good.where(F.coalesce("f.error", F.lit("")) == "")
    return good.groupBy("f.sample_index").agg(F.max_by(F.coalesce("f.error", F.lit("")), F.struct("path", "line")).alias("error"))


def index(spark: SparkSession, path: str, stream: str | None = None, valid_only: bool = True) -> DataFrame:
    """An index of samples with typed columns and t = ticks / timescale."""
    rows = spark.read.schema(INDEX).option("header", "true").csv(path)
    if stream is not None:
        rows = rows.where(F.col("stream") == stream)
    if valid_only:
        rows = rows.where(F.col("valid") == "1")
    ticks, scale = F.col("dts_ticks").cast("long"), F.col("timescale").cast("long")
    return rows.select(F.col("sample_index").cast("long").alias("sample_index"), ticks.alias("dts_ticks"), scale.alias("timescale"), "stream", "mode", (ticks / scale).alias("t"))


def coco(spark: SparkSession, path: str, category: str | None = None, with_empty: bool = False) -> DataFrame:
    """image_id, file_name, width, height, annotation_id, label, x1..y2 of COCO files (ids count in their own file). An unknown category is an error; images without annotation only if asked for.

    A document is one row when it has been read, so its parts meet where it is: files are parsed once, and nothing is shuffled.
    """
    doc = spark.read.schema(COCO).option("multiLine", "true").json(path)
    kinds = F.col("categories")
    if category is not None:
        kinds = F.filter(kinds, lambda c: c["name"] == category)
        if not doc.where(F.size(kinds) > 0).limit(1).count():
            raise ValueError(f"no category {category}")
    images = F.transform("images", lambda i: F.struct(i["id"].alias("image_id"), i["file_name"].alias("file_name"), i["width"].alias("width"), i["height"].alias("height")))
    marks = F.transform("annotations", lambda a: F.struct(a["id"].alias("annotation_id"), a["image_id"].alias("image_id"), a["category_id"].alias("category_id"), *bx.corners(a["bbox"])))
    kinds = F.transform(kinds, lambda c: F.struct(c["id"].alias("category_id"), c["name"].alias("label")))
    how = "left outer" if with_empty else "inner"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, marks, kinds = (_elements(batch.column(c)) for c in ("images", "marks", "kinds"))
            marks = marks.join(kinds, ["doc", "category_id"], join_type="inner", use_threads=False)
            yield from images.join(marks, ["doc", "image_id"], join_type=how, use_threads=False).select(names).to_batches()

    schema = "image_id long, file_name string, width int, height int, annotation_id long, label string, x1 double, y1 double, x2 double, y2 double"
    names = [c.split()[0] for c in schema.split(", ")]
    return doc.select(images.alias("images"), marks.alias("marks"), kinds.alias("kinds")).mapInArrow(joined, schema)


def _elements(lists: pa.ListArray) -> pa.Table:
    """The structs of a column of lists as a table, with doc: the row whose list they are in."""
    found = pc.list_flatten(lists)
    return pa.Table.from_arrays([pc.list_parent_indices(lists), *found.flatten()], ["doc", *(f.name for f in found.type)])


def tracking_truth(spark: SparkSession, path: str) -> DataFrame:
    """frame, pos, target, x1..y2: objects with a target id and a box that isn't empty."""
    rows = spark.read.schema(TRACKS).json(path).select("frame", F.posexplode("objects").alias("pos", "o"))
    target = F.get(F.filter("o.tags", lambda t: t["name"] == "target id"), F.lit(0))["value"].cast("long")
    out = rows.select("frame", "pos", target.alias("target"), *bx.bbox(F.col("o.points.exterior")))
    return out.where("target is not null and x2 > x1 and y2 > y1")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """run, image, pos, is_truth, score, label, x1..y2 of stored runs: thresholds can then be replayed without a detector."""
    images = spark.read.schema(RUN).option("multiLine", "true").json(path).select("run", F.explode("images").alias("i"))
    truth = images.select("run", F.col("i.file_name").alias("image"), F.posexplode("i.gt").alias("pos", "b")).select("run", "image", F.col("pos").cast("long").alias("pos"), F.lit(True).alias("is_truth"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label"), *_box(F.col("b.box")))
    found = images.select("run", F.col("i.file_name").alias("image"), F.posexplode("i.pred").alias("pos", "b")).select("run", "image", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("is_truth"), "b.score", "b.label", *_box(F.col("b.box")))
    return truth.unionByName(found)


def _box(b: Column) -> list[Column]:
    return [b[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]


def zipped(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    """sequence, name, label, x1..y2 of archives <sequence>__*.zip that hold name.json (shapes) with name.jpg. A sequence's first archive by name wins; labels not in the map go."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).withColumn("sequence", F.regexp_extract("path", r"([^/]+?)__[^/]*\.zip$", 1))
    first = archives.groupBy("sequence").agg(F.min("path").alias("path"))
    schema = "sequence string, name string, raw string, x1 double, y1 double, x2 double, y2 double"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with zipfile.ZipFile(io.BytesIO(row.content)) as z:
                    names, out = set(z.namelist()), []
                    for n in sorted(names):
                        if n.endswith(".json") and n[:-5] + ".jpg" in names:
                            for s in json.loads(z.read(n))["shapes"]:
                                xs, ys = zip(*s["points"], strict=True)
                                out.append((row.sequence, n[:-5], s["label"], float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))))
                yield pd.DataFrame(out, columns=["sequence", "name", "raw", "x1", "y1", "x2", "y2"])

    # a row an archive; their contents stay where they are read
    rows = archives.join(F.broadcast(first), ["sequence", "path"], "left_semi").select("sequence", "content").mapInPandas(unpack, schema)
    return normalised(rows, "raw", labels).where("label is not null").select("sequence", "name", "label", "x1", "y1", "x2", "y2")


def normalised(df: DataFrame, raw: str, labels: dict[str, str]) -> DataFrame:
    """df with label: the lower-cased, trimmed raw one through the map, null where it isn't in it."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return df.withColumn("label", table[F.lower(F.trim(raw))])


def clean_shapes(df: DataFrame, labels: dict[str, str], fallback: str, uncertain_below: float) -> DataFrame:
    """Boxes clipped to the image, those under a pixel dropped; label by map, else the raw one, else the fallback; uncertain if a score lies below. df: points, label, score, width, height and others."""
    rest = [c for c in df.columns if c not in ("points", "label", "score")]
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")
    raw = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    x1, y1, x2, y2 = bx.bbox(F.col("points"))
    out = df.where(F.size("points") >= 2).select(*rest, "score", raw.alias("prompt"), F.coalesce(table[raw], F.when(raw != "", raw), F.lit(fallback)).alias("label"), F.greatest(F.lit(0.0), x1).alias("x1"), F.greatest(F.lit(0.0), y1).alias("y1"), F.least(F.col("width").cast("double"), x2).alias("x2"), F.least(F.col("height").cast("double"), y2).alias("y2"))
    out = out.where((bx.width() >= 1) & (bx.height() >= 1))
    return out.withColumn("uncertain", F.coalesce(F.col("score") < uncertain_below, F.lit(False)))


def append(df: DataFrame, path: str, most_errors: int | None = None, error: str = "error") -> None:
    """Appends rows as JSON lines, in whole files that all appear at once; too many rows with an error, and none does. df is evaluated once."""
    source_lines.write_lines(df.select(F.to_json(F.struct(*df.columns)).alias("value"), *([F.col(error).cast("string").alias("error")] if most_errors is not None else [])), path, most_errors)


def chunk_progress(spark: SparkSession, path: str) -> DataFrame:
    """flight, chunks, done, open, lines of all chunks under a folder."""
    files = chunk_files(spark, path)
    n = spark.read.text(path, pathGlobFilter="*.jsonl*").groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("lines"))
    tail = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    both = files.withColumn("name", tail("path")).join(n.withColumn("name", tail("p")), "name", "left")
    return both.groupBy("flight").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def to_coco(df: DataFrame, path: str, categories: list[str], image: list[str], kept: str = "keep", dropped: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Writes images and annotations as JSON lines in COCO's fields and returns them. df: image columns, level, label, x1..y2.

    Ids are sequential over all rows (numbered by ranges, not in one task). Kept boxes are annotations of their label; boxes of
    other levels are crowds of it, of every category where it isn't one; dropped and empty boxes are left out.
    """
    from ..operators.ordered import numbered

    spark, ids = df.sparkSession, {c: k + 1 for k, c in enumerate(categories)}
    images = numbered(df.select(*image).distinct(), image).withColumn("id", F.col("place") + 1).drop("place")
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    w, h = bx.width(), bx.height()
    rows = df.where((F.col("level") != dropped) & (w > 0) & (h > 0)).join(images, image).withColumn("crowd", (F.col("level") != kept).cast("int"))
    every = F.array(*map(F.lit, ids.values()))
    rows = rows.withColumn("category_id", F.explode(F.when(table[F.col("label")].isNotNull(), F.array(table[F.col("label")])).when(F.col("crowd") == 1, every).otherwise(F.array().cast("array<int>"))))
    marks = rows.select(F.col("id").alias("image_id"), "pos", "category_id", F.array("x1", "y1", w, h).alias("bbox"), F.round(w * h, 1).alias("area"), F.col("crowd").alias("iscrowd"), F.col("crowd").alias("ignore"))
    marks = numbered(marks, ["image_id", "pos", "category_id"]).withColumn("id", F.col("place") + 1).drop("place")
    images.write.json(f"{path}/images")
    marks.write.json(f"{path}/annotations")
    return spark.read.schema(images.schema).json(f"{path}/images"), spark.read.schema(marks.schema).json(f"{path}/annotations")
