"""Token counts by separator scan over flat token files that have no index.

A file is nothing but ids (little-endian, 2 or 4 bytes each), each document ended by the end-of-document id. Files are
read in blocks that end anywhere. A first scan searches each block for the separator and keeps three numbers: how many
there are, and where the first and last end. A prefix scan of these by file gives each block the start of the document
that reaches into it and the number of documents before; a second scan then gives every document's start and length.

Defined cases: a null or empty text is a document of no ids before its separator (n_tokens counts the separator); a
separator's own string within a text is encoded as plain text, so no text holds the separator, and it is an error if one
does all the same, if a file's separators and documents differ in number, or if an id has more bytes than the file's; a
block without a separator passes on what it got; ids after a file's last separator are a document without end, which is
counted only if asked for (`unended`); an empty file, or table, has no documents; texts are encoded whole, however long;
rows that repeat a key, or have none, are documents of their own; other columns of any name aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import bpe
from .records import filesystem
from .scratch import materialise, new_path

#: Ids in a block.
BLOCK = 1 << 21
#: Tasks of a scan at most.
TASKS = 50_000


def write(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2, path: str | None = None) -> DataFrame:
    """Encodes all texts into flat files as they lie, a file a task. Returns (written): part, file, and for each document nth (in its file), key; for each file ids."""
    path = path or new_path(df.sparkSession, "flat")
    fs, folder = filesystem(path)
    fs.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = bpe.load(tokenizer), TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.bin"
        fs, folder = filesystem(path)
        nth = total = 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for block in B.gathered(batches, "text", B.BLOCK_BYTES):
                ids, count = coder.encode(*B.buffers(block.column("text")), plain=True)
                if (ids == end_id).any():
                    raise ValueError(f"a text has the separator {end_id} among its ids")
                if max(end_id, int(ids.max(initial=0))) >> 8 * width:
                    raise ValueError(f"{width} bytes an id are too few")
                ids = np.insert(ids, np.cumsum(count), end_id)
                out.write(pa.py_buffer(ids.astype(f"<u{width}")))
                n, total = len(count), total + len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([f"{path}/{name}"] * n, pa.string()), pa.array(np.arange(nth, nth + n)), block.column("key"), pa.array([None] * n, pa.int64())], names)
                nth += n
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total])], names)

    names = ["part", "file", "nth", "key", "ids"]
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return materialise(rows.mapInArrow(run, "part int, file string, nth long, key long, ids long"), "flat-written")


def block_table(spark: SparkSession, files: list[tuple[int, str, int]], block: int = BLOCK) -> DataFrame:
    """part, file, block, at, n: files as (part, file, ids) cut into blocks."""
    table = spark.createDataFrame(files, "part int, file string, ids long").where("ids > 0")
    cut = table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block).cast("long"))))
    cut = cut.select("part", "file", "block", (F.col("block") * block).alias("at"), F.least(F.lit(block).cast("long"), F.col("ids") - F.col("block") * block).alias("n"))
    return cut.repartition(_tasks(files, block), "file", "block")


def _tasks(files: list[tuple[int, str, int]], block: int) -> int:
    """A number of its own for the scans' exchanges: their rows are few bytes each, and would all be put in one task otherwise."""
    return max(1, min(TASKS, sum(-(-ids // block) for _, _, ids in files)))


def _ids(row: dict, width: int) -> np.ndarray:
    fs, name = filesystem(row["file"])
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read_at(row["n"] * width, row["at"] * width), f"<u{width}")


def scan(spark: SparkSession, files: list[tuple[int, str, int]], end_id: int, width: int = 2, block: int = BLOCK, unended: bool = False, documents_of: dict[int, int] | None = None) -> DataFrame:
    """part, nth (document in its file, from 0), at (its start in the file), n_tokens (its separator counts). documents_of: how many each part must have."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            found = np.flatnonzero(_ids(row, width) == end_id)
            last = int(found[-1]) + row["at"] + 1 if len(found) else None
            yield pa.RecordBatch.from_pylist([row | {"found": len(found), "last": last}], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("found", pa.int64()), ("last", pa.int64())])
    sums = materialise(block_table(spark, files, block).mapInArrow(summary, "part int, file string, block long, at long, n long, found long, last long"), "separators")
    if documents_of is not None:
        seen = {r.part: r.n for r in sums.groupBy("part").agg(F.sum("found").alias("n")).collect()}  # one row a file
        if odd := {p: (seen.get(p, 0), n) for p, n in documents_of.items() if seen.get(p, 0) != n}:
            raise ValueError(f"separators and documents differ in number, by part: {odd}")
    w = Window.partitionBy("part").orderBy("block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select(
        "part", "file", "at", "n", F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("nth"), F.coalesce(F.max("last").over(earlier), F.lit(0)).alias("since"),
        F.lead("block").over(w).isNull().alias("ends"),
    ).repartition(_tasks(files, block), "file", "at")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            ends = np.flatnonzero(_ids(row, width) == end_id) + row["at"] + 1
            if unended and row["ends"] and row["at"] + row["n"] > (ends[-1] if len(ends) else row["since"]):
                ends = np.append(ends, row["at"] + row["n"])
            starts = np.concatenate([[row["since"]], ends[:-1]]).astype(np.int64)[: len(ends)]
            k = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row["part"], np.int32)), pa.array(np.arange(row["nth"], row["nth"] + k)), pa.array(starts), pa.array(ends.astype(np.int64) - starts)], ["part", "nth", "at", "n_tokens"])

    return known.mapInArrow(documents, "part int, nth long, at long, n_tokens long")


def token_counts(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Writes df's texts as flat files, and counts from these: key, start (ids in all files before the document), n_tokens (with the separator)."""
    written = write(df, tokenizer, end_id, key, text, width)
    found = written.groupBy("part").agg(F.max("file").alias("file"), F.max("ids").alias("ids"), F.count("nth").alias("n")).collect()  # one row a file
    files, documents = sorted((r.part, r.file, r.ids) for r in found), {r.part: r.n for r in found}
    before, base = 0, []
    for part, _, n in files:
        base.append((part, before))
        before += n
    bases = F.broadcast(df.sparkSession.createDataFrame(base, "part int, before long"))  # one row a file
    found = scan(df.sparkSession, files, end_id, width, documents_of=documents)
    keys = written.where("nth is not null").select("part", "nth", "key")
    # by a merge: the table of keys is small as a file only
    return found.join(keys.hint("merge"), ["part", "nth"]).join(bases, "part").select(F.col("key").alias(key), (F.col("before") + F.col("at")).alias("start"), "n_tokens")
