"""Token ids in length-delimited binary records.

A file is a row of frames, each: length of the payload (8 bytes), masked CRC-32C of those 8 bytes (4), payload, masked
CRC-32C of the payload (4), all little-endian. A payload is one sequence: flags (1 byte: 1 if it has a key), bytes an id
(1 byte: 2 or 4), key (8 bytes, signed), then the ids. Beside it lies a separate offset index (`.idx`: a signature, the
number of records, then each frame's offset and the file's size, 8 bytes each), so that readers can take frames in any
order. Files are numbered in ascending order of the key, as are the frames in each.

Defined cases: a null text is the empty one, whose sequence is the end id alone; a null key comes first and is read back
as null; rows with equal keys stand in the order of a hash of their texts (so a key that very many rows share, or the lack
of one, is cut over files), then of the texts; rows that repeat key and text are side by side; a very long text is one
record, encoded in a block of its own; an empty table gives empty files; a damaged frame raises an error when read; other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import bpe
from .scratch import input_bytes, materialise, new_path

#: Fixed values of the format.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
SIGNATURE = 0x31584449_4B4C5246
#: Bytes of frames read at once.
READ_BYTES = 8 << 20
#: Bytes of input for a file, where Spark's number of shuffle partitions would make them larger.
FILE_BYTES = 256 << 20
LANE = 256


def _tables() -> np.ndarray:
    out = np.zeros((8, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    out[0] = c
    for k in range(1, 8):
        out[k] = out[0][out[k - 1] & 0xFF] ^ (out[k - 1] >> np.uint32(8))
    return out


TABLES = _tables()


def _shifts() -> np.ndarray:
    """For each j, tables (4 x 256) that take a register past 2**j zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = TABLES[0][bits & 0xFF] ^ (bits >> np.uint32(8))  # of each bit, past one byte
    out = []
    for _ in range(40):
        t = np.zeros((4, 256), np.uint32)
        for b in range(4):
            for i in range(8):
                t[b][(np.arange(256) >> i & 1) == 1] ^= image[8 * b + i]
        out.append(t)
        image = _past(image, t)
    return np.array(out)


def _past(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][c & 0xFF] ^ t[1][c >> np.uint32(8) & 0xFF] ^ t[2][c >> np.uint32(16) & 0xFF] ^ t[3][c >> np.uint32(24)]


SHIFTS = _shifts()


def _far(c: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers past so many zero bytes each."""
    c = c.copy()
    for j in range(int(zeros.max(initial=0)).bit_length()):
        m = np.flatnonzero(zeros >> j & 1)
        c[m] = _past(c[m], SHIFTS[j])
    return c


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each piece of data: lanes of one length side by side, which are then put together by shifts."""
    length = np.diff(offsets)
    n = len(length)
    lanes = -(-length // LANE)
    owner = np.repeat(np.arange(n), lanes)
    nth = B.ragged(np.zeros(n, np.int64), lanes)
    after = lanes[owner] - 1 - nth
    begin = offsets[1:][owner] - (after + 1) * LANE  # a first lane may begin before its piece: zeros there
    out = np.zeros(n, np.uint32)
    for a in range(0, len(owner), 1 << 14):
        s = slice(a, a + (1 << 14))
        at = begin[s][:, None] + np.arange(LANE)
        m = data[np.maximum(at, 0)]
        early = begin[s] < offsets[:-1][owner[s]]
        m[early] = np.where(at[early] >= offsets[:-1][owner[s]][early][:, None], m[early], 0)
        words = m.view("<u4")
        c = np.zeros(len(m), np.uint32)
        for k in range(0, LANE // 4, 2):
            x, y = words[:, k] ^ c, words[:, k + 1]
            c = TABLES[7][x & 0xFF] ^ TABLES[6][x >> 8 & 0xFF] ^ TABLES[5][x >> 16 & 0xFF] ^ TABLES[4][x >> 24] ^ TABLES[3][y & 0xFF] ^ TABLES[2][y >> 8 & 0xFF] ^ TABLES[1][y >> 16 & 0xFF] ^ TABLES[0][y >> 24]
        np.bitwise_xor.at(out, owner[s], _far(c, after[s] * LANE))
    return out ^ _far(np.full(n, 0xFFFFFFFF, np.uint32), length) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(keys: pa.Array, ids: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The frames of some sequences: bytes, and each one's offset (and the end)."""
    n = len(count)
    body = 10 + count * width
    offsets = np.concatenate([[0], np.cumsum(body + 16)]).astype(np.int64)
    out = np.zeros(int(offsets[-1]), np.uint8)
    at = offsets[:-1]

    def put(where: np.ndarray, what: np.ndarray) -> None:
        out[where[:, None] + np.arange(what.dtype.itemsize)] = what.view(np.uint8).reshape(n, -1)

    if n:
        size = body.astype("<u8")
        put(at, size)
        put(at + 8, masked(crc32c(np.ascontiguousarray(size).view(np.uint8), np.arange(n + 1) * 8)).astype("<u4"))
        out[at + 12] = keys.is_valid().to_numpy(zero_copy_only=False)
        out[at + 13] = width
        put(at + 14, keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        out[B.ragged(at + 22, count * width)] = ids.astype(f"<u{width}").view(np.uint8)
        inner = np.stack([at + 12, at + 12 + body], 1).ravel()
        crc = crc32c(out, inner)[::2]
        put(at + 12 + body, masked(crc).astype("<u4"))
    return out, offsets


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Checked frames: keys, ids, count."""
    n, at = len(offsets) - 1, offsets[:-1]
    get = lambda where, kind: np.ascontiguousarray(data[where[:, None] + np.arange(np.dtype(kind).itemsize)]).view(kind).ravel()
    if not n:
        return pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    body = get(at, "<u8").astype(np.int64)
    if (body + 16 != np.diff(offsets)).any() or (get(at + 8, "<u4") != masked(crc32c(data[at[:, None] + np.arange(8)].ravel(), np.arange(n + 1) * 8))).any():
        raise ValueError("a record's length is damaged")
    if (get(at + 12 + body, "<u4") != masked(crc32c(data, np.stack([at + 12, at + 12 + body], 1).ravel())[::2])).any():
        raise ValueError("a record is damaged")
    width = int(data[at[0] + 13])
    count = (body - 10) // width
    ids = data[B.ragged(at + 22, count * width)].view(f"<u{width}")
    return pa.array(get(at + 14, "<i8"), mask=data[at + 12] == 0), ids, count


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path.removeprefix('file:')}")


def ordered(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text in ranges of ascending keys (and hashes of texts), one for each file: one exchange."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // FILE_BYTES)
    return rows.withColumn("own", F.xxhash64("text")).repartitionByRange(n, "key", "own").sortWithinPartitions("key", "own", "text").drop("own")


def write(df: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encodes all texts, with end_id after each, and writes the files. Returns what was committed: part, file, records, ids, bytes."""
    spark = df.sparkSession
    path = path or new_path(spark, "records")
    fs, folder = filesystem(path)
    fs.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = bpe.load(tokenizer), TaskContext.get().partitionId()
        width = 2 if len(coder.name_len) <= 1 << 16 and end_id < 1 << 16 else 4
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"  # each attempt writes its own; the table says which one counts
        fs, folder = filesystem(path)
        offsets, size, total, at = [], 0, 0, 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for block in B.gathered(batches, "text", B.BLOCK_BYTES):
                ids, count = coder.encode(*B.buffers(block.column("text")))
                ids = np.insert(ids, np.cumsum(count), end_id)
                data, own = frames(block.column("key"), ids, count + 1, width)
                out.write(pa.py_buffer(data))
                offsets.append(own[:-1] + at)
                at += int(own[-1])
                size, total = size + len(count), total + len(ids)
        with fs.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(np.concatenate([[SIGNATURE, size], *offsets, [at]]).astype("<u8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{path}/{name}", "records": size, "ids": total, "bytes": at}], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    return materialise(ordered(df, key, text).mapInArrow(run, "part int, file string, records long, ids long, bytes long"), "records-written")


def read(files: DataFrame) -> DataFrame:
    """All records in order: key, start (ids of all records before), ids (little-endian unsigned 32-bit)."""
    spark = files.sparkSession
    rows, before = [], 0
    for f in sorted(files.collect()):  # one row a file
        rows.append((f.file, before, f.records))
        before += f.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            fs, name = filesystem(row["file"])
            with fs.open_input_file(f"{name}.idx") as f:
                index = np.frombuffer(f.read(), "<u8").astype(np.int64)
            if int(index[0]) != SIGNATURE or index[1] != row["records"] or len(index) != index[1] + 3:
                raise ValueError(f"the index of {row['file']} is damaged")
            offsets, start, at = index[2:], row["before"], 0
            with fs.open_input_file(name) as f:
                while at < row["records"]:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_BYTES, "right")) - 1)
                    data = np.frombuffer(f.read_at(int(offsets[to] - offsets[at]), int(offsets[at])), np.uint8)
                    keys, ids, count = parse(data, offsets[at : to + 1] - offsets[at])
                    ends = start + np.cumsum(count)
                    ids_ = B.binary_of(ids.astype("<u4").view(np.uint8), count * 4).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(ends - count), ids_], ["key", "start", "ids"])
                    start, at = int(ends[-1]), to

    table = spark.createDataFrame(rows, "file string, before long, records long").repartition(max(1, len(rows)), "file")
    return table.mapInArrow(run, "key long, start long, ids binary")
