"""Substring dedup by super-k-mer partitioning.

A window is `size` consecutive words of one document. Of equal windows the earliest (smallest key, then earliest start)
stays; words that any later one covers are removed. Windows are judged on the input, not on what is left.

Each window has a minimiser: the least hash of its grams of GRAM words. Consecutive windows with the same minimiser travel
to its bucket as one packed string, and equal windows therefore meet. There, sorting counts them exactly: hashes bring
equal windows together, and their words are compared. Before they leave, the windows of a block of texts are compared
with each other in the same way, and only a block's earliest travels; so a passage that a third of all rows repeat is
sent once for each block, not once for each row, and no bucket grows with the number of copies.

A first pass counts the exact bytes that each bucket would get from all texts. Grams of buckets beyond LARGE rank last,
so their windows go where another gram leads; windows that hold no others go by the hash of the whole window, spread
over all buckets. So no bucket grows with a gram's share of the corpus. What tasks get of this is a bit for each bucket.

Defined cases: a null or empty text has no words; a text of fewer words than a window loses none; rows that repeat a key
count as one document in this order, so neither of two equal windows at the same start is earlier, and both stay, but each
row loses its own words only (a row is known by its key and a hash of its text); a null key is smaller than any other; texts and words of any length are taken whole; an empty table gives an empty result;
other columns aren't read (dedup) or come along unchanged (rewritten).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .scratch import materialise

#: Words in a gram.
GRAM = 5
#: Bytes of text for a bucket; super-k-mers overlap, so that a bucket holds some three times as much.
BUCKET_BYTES = 1 << 20
#: Bytes of super-k-mers from which on a bucket's grams rank last.
LARGE = 8 << 20
#: Bytes of text whose windows are compared before they travel.
BLOCK = 2 << 20
#: Bits of the map that says which texts may lose words (8 MB at most; where it fills up, more rows move than need to).
MARKS = 1 << 26
#: Bytes from which on a packed string is compressed by itself.
WORTH = 512
LOW = -(1 << 63)
#: Seed of Spark's xxhash64.
SEED = 42
STEP, TOP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(1 << 63)


class Block:
    """Words of some documents in ascending order of key."""

    def __init__(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, size: int):
        self.size = size
        starts, ends, self.packed, self.first = B.words(data, offsets)
        self.length = ends - starts
        self.code, distinct = B.codes(self.packed, self.length)
        self.distinct = distinct
        self.keys = keys
        n = len(starts)
        self.valid = np.zeros(n, bool)
        fit = self.first[1:] - self.first[:-1] >= size
        if n and fit.any():
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, self.first[:-1][fit], 1)
            np.add.at(edge, self.first[1:][fit] - size + 1, -1)
            self.valid = np.cumsum(edge[:-1]) > 0
        self.at = np.flatnonzero(self.valid)
        self.doc = np.searchsorted(self.first, self.at, "right") - 1

    @cached_property
    def hashed(self) -> np.ndarray:
        """Hash of each word."""
        return B.hashes(self.distinct)[self.code]

    def windows(self) -> np.ndarray:
        """Hash of the words of each window in self.at."""
        n = len(self.code)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, STEP, np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.hashed * power[:n])])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(STEP), -1, 1 << 64)), np.uint64)]))
        return B.mix((total[self.at + self.size] - total[self.at]) * back[self.at])

    def minimisers(self, buckets: int, large: np.ndarray | None = None, whole: np.ndarray | None = None) -> np.ndarray:
        """The minimiser of each window in self.at. large: marks buckets whose grams rank last; whole: what stands for windows that hold no others."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        n = min(GRAM, self.size)
        g = B.grams(self.hashed, n) & ~TOP
        if large is not None and large.any():
            g |= large[bucket_of(g, buckets)].astype(np.uint64) << np.uint64(63)
        out = least(g, self.size - n + 1)[self.at]
        return out if whole is None else np.where(out >= TOP, whole | TOP, out)


def bucket_of(minimiser: np.ndarray, buckets: int) -> np.ndarray:
    return (B.mix(minimiser) % np.uint64(buckets)).astype(np.int64)


def runs(minimiser: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Super-k-mers: the first window of each, and how many it has."""
    new = np.ones(len(at), bool)
    new[1:] = (minimiser[1:] != minimiser[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(at)))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def repeats(hashes: np.ndarray, code: np.ndarray, at: np.ndarray, size: int, before) -> np.ndarray:
    """Indices (into at) of windows that an earlier one equals, word by word. at: in the order of what is earliest; before(i, j): i is strictly earlier than j."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    later = np.flatnonzero(~new)
    if not len(later):
        return later
    first = order[np.flatnonzero(new)[np.cumsum(new)[later] - 1]]
    later = order[later]
    same = np.ones(len(later), bool)
    for k in range(size):
        same &= code[at[later] + k] == code[at[first] + k]
    out = later[same & before(first, later)]
    if not same.all():  # two windows, one hash: by their words
        earliest: dict[tuple, int] = {}
        odd = np.unique(hashes[later[~same]])
        for i in np.flatnonzero(np.isin(hashes, odd)).tolist():
            j = earliest.setdefault((int(hashes[i]), *code[at[i] : at[i] + size].tolist()), i)
            if j != i and before(np.array([j]), np.array([i]))[0]:
                out = np.append(out, i)
        out = np.unique(out)
    return out


def intervals(doc: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What windows cover, put together where they touch: doc, from, to."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1 if len(doc) else head
    return doc[head], start[head], start[last] + size


def _sorted_block(block: pa.RecordBatch, size: int) -> Block:
    keys = block.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    data, offsets = B.buffers(B.text_array(block.column("text")).take(pa.array(order)))
    out = Block(keys[order], data, offsets, size)
    out.own = digests(data, offsets)
    return out


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for each text: with the key it says which row spans belong to."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh64_intdigest(raw[a:z], SEED) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOW)).alias("key"), F.col(f"`{text}`").alias("text"))


def large_buckets(df: DataFrame, size: int, buckets: int, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Marks the buckets that would get over LARGE bytes of super-k-mers: exact sums over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.gathered(batches, "text", BLOCK):
            data, offsets = B.buffers(block.column("text"))
            b = Block(np.zeros(len(offsets) - 1, np.int64), data, offsets, size)
            m = b.minimisers(buckets)
            if len(m):
                head, n = runs(m, b.at)
                to = np.cumsum(b.length + 1)
                first = b.at[head]
                bucket, which = np.unique(bucket_of(m[head], buckets), return_inverse=True)
                sums = np.bincount(which, to[first + n + size - 2] - to[first] + b.length[first] + 1)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(sums.astype(np.int64))], ["bucket", "bytes"])

    sums = _rows(df, key, text).mapInArrow(count, "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    out = np.zeros(buckets, bool)
    out[[r.bucket for r in sums.where(F.col("bytes") > LARGE).select("bucket").collect()]] = True  # at most as many as LARGE goes into all super-k-mers
    return out


def packed(df: DataFrame, size: int, buckets: int, large: np.ndarray, key: str, text: str) -> DataFrame:
    """bucket, kind, n, raw, blob: super-k-mers of a block for a bucket (kind 0), or intervals known in a block (kind 1). raw: bytes of what blob holds, compressed if it is shorter."""
    marked = np.packbits(large)  # a bit for each BUCKET_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = np.unpackbits(marked, count=buckets).astype(bool)
        for block in B.gathered(batches, "text", BLOCK):
            rows = []
            for row in _super_kmers(_sorted_block(block, size), size, buckets, large):
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names, kinds = ["bucket", "kind", "n", "raw", "blob"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return _rows(df, key, text).mapInArrow(run, "bucket long, kind int, n long, raw long, blob binary")


def _blob(data: bytes) -> tuple[int, bytes]:
    short = pa.Codec("zstd", compression_level=1).compress(data).to_pybytes() if len(data) >= WORTH else data
    return len(data), short if len(short) < len(data) else data


def _super_kmers(b: Block, size: int, buckets: int, large: np.ndarray) -> Iterator[tuple]:
    if not len(b.at):
        return
    whole, start = b.windows(), b.at - b.first[b.doc]
    again = repeats(whole, b.code, b.at, size, lambda i, j: (b.keys[b.doc[i]] < b.keys[b.doc[j]]) | ((b.doc[i] == b.doc[j]) & (b.at[i] < b.at[j])))
    if len(again):
        d, lo, hi = intervals(b.doc[again], start[again], size)
        yield int(b.own[d[0]]) % buckets, 1, len(d), *_blob(np.concatenate([b.keys[d], b.own[d], lo, hi]).tobytes())
    travels = np.ones(len(b.at), bool)
    travels[again] = False
    m, at, doc, start = b.minimisers(buckets, large, whole)[travels], b.at[travels], b.doc[travels], start[travels]
    del whole, again, travels
    if not len(m):
        return
    head, n = runs(m, at)
    bucket = bucket_of(m[head], buckets)
    order = np.argsort(bucket, kind="stable")
    head, n, bucket = head[order], n[order], bucket[order]
    del m
    # all words with one space after each
    to = np.cumsum(b.length + 1)
    frm = to - b.length - 1
    spaced = np.full(int(to[-1]), 32, np.uint8)
    spaced[B.ragged(frm, b.length)] = b.packed
    x, z = frm[at[head]], to[at[head] + n + size - 2]
    key, own, start = b.keys[doc[head]], b.own[doc[head]], start[head]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for i, j in zip(edges.tolist(), np.append(edges[1:], len(bucket)).tolist(), strict=True):
        meta = np.concatenate([key[i:j], own[i:j], start[i:j], n[i:j], z[i:j] - x[i:j]]).tobytes()
        yield int(bucket[i]), 0, j - i, *_blob(meta + spaced[B.ragged(x[i:j], z[i:j] - x[i:j])].tobytes())


def _bucket(size: int, rows: bool = False):
    """Of a bucket: key, lo, hi of the words that go; with rows also own, the text's hash, which tells rows of one key apart."""

    def run(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        found: dict[str, list] = defaultdict(list)
        for row in table.select(["kind", "n", "raw", "blob"]).to_pylist():
            raw = codec.decompress(row["blob"], row["raw"]).to_pybytes() if len(row["blob"]) < row["raw"] else row["blob"]
            if row["kind"]:
                found["known"].append(np.frombuffer(raw, np.int64).reshape(4, -1))
            else:
                found["meta"].append(np.frombuffer(raw, np.int64, 5 * row["n"]).reshape(5, -1))
                found["text"].append(np.frombuffer(raw, np.uint8, offset=40 * row["n"]))
        parts = [tuple(np.concatenate(found["known"], 1))] if found["known"] else []
        if found["meta"]:
            key, own, start, n, length = np.concatenate(found["meta"], 1)
            offsets = np.concatenate([[0], np.cumsum(length)])
            b = Block(key, np.concatenate(found["text"]), offsets, size)
            at = b.at
            key, own, start = key[b.doc], own[b.doc], start[b.doc] + at - b.first[b.doc]
            order = np.lexsort((start, key))
            at, key, own, start = at[order], key[order], own[order], start[order]
            again = repeats(b.windows()[order], b.code, at, size, lambda i, j: (key[i] < key[j]) | ((key[i] == key[j]) & (start[i] < start[j])))
            for_row = np.lexsort((own[again], key[again]))
            again = again[for_row]
            new = np.ones(len(again), bool)
            new[1:] = (key[again][1:] != key[again][:-1]) | (own[again][1:] != own[again][:-1])
            head = again[new]
            row, lo, hi = intervals(np.cumsum(new) - 1, start[again], size)
            parts.append((key[head][row], own[head][row], lo, hi))
        key, own, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        out = {"key": pa.array(key, pa.int64()), "own": pa.array(own, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())}
        return pa.table(out if rows else {c: x for c, x in out.items() if c != "own"})

    return run


def removals(df: DataFrame, size: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (null: the smallest long), own (the text's hash), spans: the words (from, to) that go, in any order, overlapping."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0  # not the size of its files, which are compressed
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 64, total // BUCKET_BYTES)
    large = large_buckets(df, size, buckets, key, text)
    found = packed(df, size, buckets, large, key, text).groupBy("bucket").applyInArrow(_bucket(size, rows=True), "key long, own long, lo long, hi long")
    return materialise(found.groupBy("key", "own").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "removals")  # different spans of one text: what copies of a row repeat goes map-side


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in B.blocks(batches, "text", BLOCK):
        starts, ends, packed_, first = B.words(*B.buffers(block.column("text")))
        spans = block.column("spans")
        own = pc.list_parent_indices(spans).to_numpy()
        flat = pc.list_flatten(spans)
        edge = np.zeros(len(starts) + 1, np.int64)
        if len(own):
            if (flat.field("hi").to_numpy() > np.diff(first)[own]).any():
                raise ValueError("spans go beyond the words of their text")
            np.add.at(edge, first[own] + flat.field("lo").to_numpy(), 1)
            np.add.at(edge, first[own] + flat.field("hi").to_numpy(), -1)
        stays = np.cumsum(edge[:-1]) == 0
        length = ends - starts
        kept_to = np.cumsum((length + 1) * stays)
        out = np.full(int(kept_to[-1]) if len(kept_to) else 0, 32, np.uint8)
        n = np.flatnonzero(stays)
        word_at = np.cumsum(length) - length
        out[B.ragged(kept_to[n] - length[n] - 1, length[n])] = packed_[B.ragged(word_at[n], length[n])]
        count = np.diff(first)
        gone = np.concatenate([[0], np.cumsum(~stays)])
        removed = gone[first[1:]] - gone[first[:-1]]
        ends_ = np.concatenate([[0], kept_to])
        a, z = ends_[first[:-1]], ends_[first[1:]]
        z = np.where(z > a, z - 1, z)  # no space after the last
        size = z - a
        texts = B.binary_of(out[B.ragged(a, size)], size).cast(pa.string())
        yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(count), pa.array(removed), texts], ["row", "n_words", "n_removed", "kept"])


def apart(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose texts may be in gone (both have own, the text's hash), and those that aren't: told by bitmaps, MARKS bits in all, so only the first need to move."""
    bit = F.pmod(F.col("own"), F.lit(MARKS))
    part, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    maps = gone.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    told = rows.withColumn("part", part).join(F.broadcast(maps), "part", "left").withColumn("moves", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)))
    return tuple(told.where(x).drop("part", "bits", "moves") for x in (F.col("moves"), ~F.col("moves")))


def dedup(df: DataFrame, size: int = 20, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row: row (a struct of key, or of the columns to carry), n_words, n_removed, kept (the words that stay, joined by one space).

    Rows move to the spans of their texts, those without any stay: a bitmap says which may have some. A text moves once, also where it is carried.
    """
    gone = removals(df, size, key, text)
    carry = carry or [key]
    own = F.xxhash64(F.col(f"`{text}`"))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOW)).alias("key"), own.alias("own"), *([] if text in carry else [F.col(f"`{text}`").alias("text")]))
    schema = T.StructType([out.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept string")])
    some, rest = apart(out, gone)
    rows = some.join(gone, ["key", "own"], "left").unionByName(rest.withColumn("spans", F.lit(None).cast(gone.schema["spans"].dataType)))
    return rows.select("row", (F.col(f"row.`{text}`") if text in carry else F.col("text")).alias("text"), "spans").mapInArrow(_kept, schema)
