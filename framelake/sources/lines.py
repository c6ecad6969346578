"""Two data sources of our own: chunk files of frames, read with pruning, and lines written with an error budget.

`framelake_chunks` reads folders of `<flight>_chunk_<start>_<end>.jsonl[.zst]`. A flight and a range of sample_index are
options: files whose range doesn't meet it are dropped before any is opened. (The range isn't taken from pushed filters:
Spark 4.1 keeps what one plan pushes with the relation, and a second plan over it would read the first one's files.) Small
files share a partition, plain ones are split where they are large, compressed ones are read as a stream in a partition.
Folders are listed by Arrow's file systems, in one call.

`framelake_lines` writes lines to files that tasks fill in a staging folder. Each task reports its files and how many of its
rows had an error; the commit adds these up, and either moves all files into place or, over the budget, removes them and
fails. So the input is evaluated once, and nothing shows before the number of errors is known. Rows of annotations become
COCO documents as they are written: their texts are made in the task that writes them, and no list of a document's is.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = re.compile(r"([^/]+)_chunk_(\d+)_(\d+)\.(jsonl|jsonl\.zst|done)$")
COLUMNS = "flight string, start long, end long, path string, block long, line int, sample_index long, value string"
#: Bytes of files that share a partition, or of a part of a plain file; bytes of a stream worked on at once.
PART_BYTES, STREAM_BYTES = 64 << 20, 4 << 20
INDEX = r'^\s*\{[^{}\[\]]*"sample_index"\s*:\s*(?P<i>-?\d{1,18})\s*[,}]'


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it."""
    bare = re.sub(r"^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in bare else f"file://{bare}")


@dataclass(frozen=True)
class Chunk:
    flight: str
    start: int
    end: int
    path: str
    size: int
    done: bool


def listed(path: str) -> list[Chunk]:
    """Chunks under a folder: compressed files rather than plain ones of the same range, and whether there is a marker."""
    fs, root = store(path)
    files: dict[tuple, pa.fs.FileInfo] = {}
    done = set()
    for f in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True, recursive=True)):
        if f.is_file and (m := CHUNK.search(f.path)):
            key = (m[1], int(m[2]), int(m[3]))
            if m[4] == "done":
                done.add(key)
            elif key not in files or m[4] == "jsonl.zst":
                files[key] = f
    return [Chunk(*key, f.path, f.size, key in done) for key, f in sorted(files.items())]


@dataclass
class Part(InputPartition):
    pieces: list[tuple[Chunk, int, int]]


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.flight = options["path"], options.get("flight")
        self.partial, self.bytes = str(options.get("partial", "false")).lower() == "true", int(options.get("partBytes", PART_BYTES))
        self.low, self.high = (int(options[k]) if k in options else None for k in ("from", "to"))

    def partitions(self) -> list[Part]:
        found = [c for c in listed(self.path) if (self.flight is None or c.flight == self.flight) and (self.low is None or c.end > self.low) and (self.high is None or c.start < self.high)]
        if not self.partial and (unfinished := [c.path for c in found if not c.done]):
            raise ValueError(f"chunks not finished: {unfinished}")
        pieces = []
        for c in (c for c in found if c.done):
            step = c.size if c.path.endswith(".zst") else self.bytes
            pieces += [(c, at, min(at + step, c.size)) for at in range(0, max(c.size, 1), max(step, 1))]
        parts, held = [], 0
        for piece in pieces:
            size = piece[2] - piece[1]
            if not parts or held + size > self.bytes:
                parts.append(Part([]))
                held = 0
            parts[-1].pieces.append(piece)
            held += size
        for k, p in enumerate(parts):
            p.value = k
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for chunk, at, to in partition.pieces if partition else []:
            fs, _ = store(self.path)
            number = 0
            for values in _lines(fs, chunk.path, at, to):
                n = len(values)
                lines = pa.array(range(number, number + n), pa.int32())
                number += n
                full = pc.not_equal(values, "")
                values, lines = values.filter(full), lines.filter(full)
                same = lambda v, t, m=len(values): pa.repeat(pa.scalar(v, t), m)
                yield pa.RecordBatch.from_arrays(
                    [same(chunk.flight, pa.string()), same(chunk.start, pa.int64()), same(chunk.end, pa.int64()), same(chunk.path, pa.string()), same(at, pa.int64()), lines, indices(values), values],
                    ["flight", "start", "end", "path", "block", "line", "sample_index", "value"],
                )


def indices(values: pa.Array) -> pa.Array:
    """The sample_index of each line's object, null where there is none. Lines that name it before anything nested, and once, are told by a pattern; others that name it are parsed."""
    fast = pc.struct_field(pc.extract_regex(values, INDEX), "i").cast(pa.int64())
    named = pc.count_substring(values, '"sample_index"')
    odd = pc.indices_nonzero(pc.or_(pc.greater(named, 1), pc.and_(pc.greater(named, 0), pc.is_null(fast)))).to_pylist()
    if not odd:
        return fast
    out = fast.to_pylist()
    for k in odd:
        try:
            own = json.loads(values[k].as_py())
        except ValueError:
            own = None
        own = own.get("sample_index") if isinstance(own, dict) else None
        out[k] = own if isinstance(own, int) and abs(own) < 1 << 63 else None
    return pa.array(out, pa.int64())


def _lines(fs: pa.fs.FileSystem, path: str, at: int, to: int) -> Iterator[pa.Array]:
    """Lines that begin in [at, to) of a file, some at a time; of a compressed file all."""
    if path.endswith(".zst"):
        with fs.open_input_stream(path, compression="zstd") as f:
            rest = b""
            while data := f.read(STREAM_BYTES):
                *lines, rest = (rest + data).split(b"\n")
                yield _texts(lines)
            if rest:
                yield _texts([rest])
        return
    with fs.open_input_file(path) as f:
        size = f.size()
        before = max(at - 1, 0)
        data = f.read_at(min(to, size) - before, before)
        if at > 0:  # a line that begins before belongs to the part before
            data = data[data.index(b"\n") + 1 :] if b"\n" in data else b""
            if not data:
                return
        end = to
        while end < size and not data.endswith(b"\n"):
            more = f.read_at(min(1 << 16, size - end), end)
            cut = more.find(b"\n") + 1
            data += more[:cut] if cut else more
            end += cut or len(more)
        yield _texts(data.removesuffix(b"\n").split(b"\n") if data else [])


def _texts(lines: list[bytes]) -> pa.Array:
    try:
        texts = pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8 throughout
        texts = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
    return pc.utf8_rtrim(texts, "\r")


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framelake_chunks"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]
    rows: int
    errors: int


class LinesWriter(DataSourceArrowWriter):
    """value: a line (null: none, only the file); file: its file's name, if rows say so (rows of one file should lie together); error: null if there is none."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most = int(options["mostErrors"]) if "mosterrors" in {k.lower() for k in options} else None
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        first = next(iterator := iter(iterator), None)
        if first is None:
            return Written([], 0, 0)
        iterator = chain([first], iterator)
        if "annotation_id" in first.schema.names:
            iterator = coco_documents(iterator)
        fs, root = store(self.path)
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # each attempt has its own folder
        files, rows, errors, open_, name = [], 0, 0, None, None
        for batch in iterator:
            columns = {c: batch.column(c) for c in batch.schema.names}
            rows += batch.num_rows
            errors += batch.num_rows - columns["error"].null_count if "error" in columns else 0
            names = columns["file"].to_pylist() if "file" in columns else [f"part-{own.rpartition('/')[2]}.jsonl"] * batch.num_rows
            values = columns["value"]
            at = 0
            for k in range(1, len(names) + 1):
                if k < len(names) and names[k] == names[at]:
                    continue
                if names[at] != name:
                    if open_:
                        open_.close()
                    name = names[at]
                    staged = f"{own}/{len(files)}"
                    fs.create_dir(own)
                    open_ = fs.open_output_stream(staged)
                    files.append((staged, f"{root}/{name}"))
                if len(own_lines := values.slice(at, k - at).drop_null()):
                    # joined as they lie in Arrow's buffers, without an object for each
                    open_.write(pc.binary_join(pa.ListArray.from_arrays([0, len(own_lines)], own_lines), "\n")[0].as_buffer())
                    open_.write(b"\n")
                at = k
        if open_:
            open_.close()
        return Written(files, rows, errors)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        found = [m for m in messages if m is not None]
        errors = sum(m.errors for m in found)
        try:
            if self.most is not None and errors > self.most:
                raise ValueError(f"{errors} rows with errors, more than {self.most}: nothing is written")
            fs.create_dir(root)
            for staged, path in (f for m in found for f in m.files):  # names only
                fs.move(staged, path)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


def coco_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, value: COCO documents, each some lines that follow one another. Rows: document (rows of one lie together), image_id, file_name (null but in one row
    of an image), width, height, annotation_id, category_id, label, x1, y1, w, h."""
    now, images, marks, kinds = None, [], [], {}

    def done() -> pa.RecordBatch:
        named = [{"id": i, "name": n} for i, n in kinds]
        values = ['{"images":[', *_joined(images), '],"annotations":[', *_joined(marks), f'],"categories":{json.dumps(named)}}}']
        return pa.RecordBatch.from_arrays([pa.array([f"{'null' if now[0] is None else now[0]}.json"] * len(values)), pa.array(values)], ["file", "value"])

    for batch in batches:
        c = {k: batch.column(k) for k in batch.schema.names}
        mark = _text('{"id":', c["annotation_id"], ',"image_id":', c["image_id"], ',"category_id":', c["category_id"], ',"bbox":[', c["x1"], ",", c["y1"], ",", c["w"], ",", c["h"], "]}")
        own = pc.is_valid(c["file_name"])
        names = c["file_name"].filter(own)
        quoted = pa.array([json.dumps(n) for n in names.to_pylist()], pa.string()) if pc.any(pc.match_substring_regex(names, r'[\\"\x00-\x1f]')).as_py() else _text('"', names, '"')
        image = _text('{"id":', c["image_id"].filter(own), ',"file_name":', quoted, ',"width":', c["width"].filter(own), ',"height":', c["height"].filter(own), "}")
        before = pc.cumulative_sum(own.cast(pa.int32())).to_numpy()  # images up to each row
        runs = pc.run_end_encode(c["document"])
        at = 0
        for document, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if now != (document,):
                if now:
                    yield done()
                now, images, marks, kinds = (document,), [], [], {}
            i = int(before[at - 1]) if at else 0
            images.append(image.slice(i, int(before[end - 1]) - i))
            marks.append(mark.slice(at, end - at))
            pairs = pa.table({k: c[k].slice(at, end - at) for k in ("category_id", "label")}).group_by(["category_id", "label"], use_threads=False).aggregate([])
            kinds |= dict.fromkeys(zip(*(x.to_pylist() for x in pairs.columns), strict=True))
            at = end
    if now:
        yield done()


def _text(*parts: str | pa.Array) -> pa.Array:
    """Parts side by side as text, nulls as JSON's null."""
    texts = [x if isinstance(x, str) else x.cast(pa.string()) for x in parts]
    return pc.binary_join_element_wise(*texts, "", null_handling="replace", null_replacement="null")


def _joined(pieces: list[pa.Array]) -> list[str]:
    """All texts of some arrays, with commas between them."""
    whole = pa.concat_arrays(pieces)
    return [pc.binary_join(pa.ListArray.from_arrays([0, len(whole)], whole), ",")[0].as_py()] if len(whole) else []


class LinesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framelake_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        if overwrite:
            raise ValueError("lines are appended only")
        return LinesWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows both sources."""
    for source in (ChunkSource, LinesSink):
        spark.dataSource.register(source)
    return spark


def chunks(spark: SparkSession, path: str, flight: str | None = None, start: int | None = None, end: int | None = None, partial: bool = False) -> DataFrame:
    """Lines of chunk files with their place (see COLUMNS); with start or end only those of samples in [start, end), and only files that may hold some."""
    options = {"partial": str(partial).lower(), "flight": flight, "from": start, "to": end}
    out = registered(spark).read.format(ChunkSource.name()).options(**{k: v for k, v in options.items() if v is not None}).load(path)
    if start is not None:
        out = out.where(F.col("sample_index") >= start)
    return out if end is None else out.where(F.col("sample_index") < end)


def write_lines(df: DataFrame, path: str, most_errors: int | None = None) -> None:
    """Appends df's lines (value, and file and error if it has them) under a folder; over most_errors rows with an error, nothing. Annotations
    (annotation_id and the other columns that coco_documents names) become COCO documents, a file each."""
    registered(df.sparkSession)
    writer = df.write.format(LinesSink.name()).mode("append")
    (writer if most_errors is None else writer.option("mostErrors", most_errors)).save(path)
