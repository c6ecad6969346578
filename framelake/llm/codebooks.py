"""Compression of vectors to codes: product quantisation by filtering Lloyd, in whole numbers.

Components become floor(scale * x). A vector is cut into equal consecutive parts; each part position has a codebook. Every
partition builds, for blocks of its vectors, a kd-tree over the parts at each position, whose nodes cache a bounding box
and the sum and count of their points. The trees are written once. In a round, entries go down the trees: an entry that is
farther than another one from all of a node's box is eliminated there, and where one entry is left, the whole subtree is
assigned to it at once by the node's sum and count; what reaches the leaves is compared point by point. All is done level
by level in numpy and in 64-bit integers, so sums, ties (to the lower entry) and codes are exact.

Tasks send a row for each entry of each codebook with their own sums, which Spark adds up; the driver holds codebooks only.

Defined cases: vectors null, empty, of another length than most, or with null or non-finite components are left out; rows
that repeat an id are each coded; codebooks start from the rows with the smallest ids, a null id last, equal ids by their
components; with fewer rows than entries, codebooks have as many entries as there are rows; entries without points stay;
equal entries give ties, which go to the lower one; a length that isn't a multiple of the number of parts, or a component
of 2**25 and more after scaling, is an error; an empty table gives an empty result; other columns come along in `row`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .scratch import looked_up, materialise

#: Vectors of a block, whose trees are one row; numbers that these may have.
BLOCK, BLOCK_NUMBERS = 1 << 13, 1 << 20
#: Points of a leaf, about.
LEAF = 8
#: Components beyond this can't be squared and summed in 64 bits.
MOST = 1 << 25


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(vectors.astype(np.float64) * scale)
    if len(out) and np.abs(out).max() >= MOST:
        raise ValueError(f"components of {MOST} and more after scaling can't be coded")
    return out.astype(np.int64)


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each entry."""
    out = np.zeros((len(points), len(book)), np.int64)
    for d in range(points.shape[1]):
        gap = points[:, d, None] - book[None, :, d]
        out += gap * gap
    return out


class Tree:
    """A balanced kd-tree over whole-number points. Level l has 2**l nodes; a node's points lie side by side in `points`."""

    def __init__(self, points: np.ndarray, order: np.ndarray, edges: list[np.ndarray], lo: list[np.ndarray], hi: list[np.ndarray]):
        self.points, self.order, self.edges, self.lo, self.hi = points, order, edges, lo, hi
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0)])
        self.sums = [total[e[1:]] - total[e[:-1]] for e in edges]

    @classmethod
    def build(cls, points: np.ndarray) -> "Tree":
        n = len(points)
        order, edges, lo, hi = np.arange(n), [], [], []
        depth = max(0, (n // LEAF).bit_length() - 1)
        for level in range(depth + 1):
            e = np.arange((1 << level) + 1, dtype=np.int64) * n >> level
            mine = points[order]
            low, high = np.minimum.reduceat(mine, e[:-1], axis=0), np.maximum.reduceat(mine, e[:-1], axis=0)
            edges.append(e)
            lo.append(low)
            hi.append(high)
            if level < depth:  # each node's points in the order of its box's longest side; halves become children
                axis = (high - low).argmax(1)
                node = np.repeat(np.arange(1 << level), np.diff(e))
                order = order[np.lexsort((mine[np.arange(n), axis[node]], node))]
        return cls(points[order], order, edges, lo, hi)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point (in the order that points came in), and the sum and count of each entry's points."""
        k, n = len(book), len(self.points)
        code, sums, counts = np.zeros(n, np.int64), np.zeros_like(book), np.zeros(k, np.int64)
        nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level, edges in enumerate(self.edges):
            lo, hi = self.lo[level][nodes], self.hi[level][nodes]
            # the entry nearest to the middle of the box, among those that are left
            middle = np.where(left, distances(lo + hi, 2 * book), np.iinfo(np.int64).max)
            best = middle.argmin(1)
            # of all points of the box, the one most in favour of an entry against `best` lies at the corner towards that entry
            gain = np.zeros((len(nodes), k), np.int64)
            for d in range(book.shape[1]):
                z, b = book[None, :, d], book[best, d][:, None]
                corner = np.where(z > b, hi[:, d, None], lo[:, d, None])
                gain += (z - corner) ** 2 - (b - corner) ** 2
            left &= (gain < 0) | ((gain == 0) & (np.arange(k)[None, :] <= best[:, None]))
            one = left.sum(1) == 1
            if one.any():
                which, node = left[one].argmax(1), nodes[one]
                size = edges[node + 1] - edges[node]
                code[B.ragged(edges[node], size)] = np.repeat(which, size)
                np.add.at(sums, which, self.sums[level][node])
                np.add.at(counts, which, size)
            nodes, left = nodes[~one], left[~one]
            if not len(nodes):
                break
            if level + 1 < len(self.edges):
                nodes, left = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([left, left])
        else:
            size = edges[nodes + 1] - edges[nodes]
            at = B.ragged(edges[nodes], size)
            own = np.repeat(np.arange(len(nodes)), size)
            far = np.where(left[own], distances(self.points[at], book), np.iinfo(np.int64).max)
            code[at] = far.argmin(1)
            np.add.at(sums, code[at], self.points[at])
            counts += np.bincount(code[at], minlength=k)
        out = np.empty(n, np.int64)
        out[self.order] = code
        return out, sums, counts

    def dump(self) -> bytes:
        n, d = self.points.shape
        boxes = [x for pair in zip(self.lo, self.hi, strict=True) for x in pair]
        return b"".join([np.array([n, d, len(self.edges)], np.int64).tobytes(), self.order.astype(np.int32).tobytes(), self.points.astype(np.int32).tobytes(), *(x.astype(np.int32).tobytes() for x in boxes)])

    @classmethod
    def load(cls, raw: memoryview) -> tuple["Tree", int]:
        """A tree, and the bytes it took."""
        n, d, levels = np.frombuffer(raw, np.int64, 3).tolist()
        numbers = np.frombuffer(raw, np.int32, n + n * d + 2 * d * ((1 << levels) - 1), 24).astype(np.int64)
        at, boxes = n + n * d, []
        for level in range(levels):
            for _ in range(2):
                boxes.append(numbers[at : at + (d << level)].reshape(-1, d))
                at += d << level
        edges = [np.arange((1 << level) + 1, dtype=np.int64) * n >> level for level in range(levels)]
        return cls(numbers[n : n + n * d].reshape(n, d), numbers[:n], edges, boxes[::2], boxes[1::2]), 24 + 4 * len(numbers)


def trees(rows: DataFrame, parts: int, dim: int, scale: int) -> DataFrame:
    """rows, trees: blocks of rows (lists of structs) with the trees of their parts, one after the other, written. rows: row, x."""
    most = max(1, min(BLOCK, BLOCK_NUMBERS // dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = whole(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim), scale)
            blob = b"".join(Tree.build(part).dump() for part in np.split(x, parts, 1))
            row = table["row"].combine_chunks()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), pa.array([blob], pa.binary())], ["rows", "trees"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - size)
                held.append(piece)
                at, size = at + piece.num_rows, size + piece.num_rows
                if size == most:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    schema = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("trees", T.BinaryType())])
    return materialise(rows.mapInArrow(run, schema), "trees")


def each_tree(blob: bytes, parts: int) -> Iterator[Tree]:
    raw, at = memoryview(blob), 0
    for _ in range(parts):
        tree, size = Tree.load(raw[at:])
        at += size
        yield tree


def improved(planted: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floor of the mean of their points. books: part x entry x component."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, k), np.int64)
        for batch in batches:
            for blob in batch.column("trees").to_pylist():
                for p, tree in enumerate(each_tree(blob, parts)):
                    _, s, c = tree.assign(books[p])
                    sums[p] += s
                    counts[p] += c
        at = np.flatnonzero(counts.ravel())  # an entry a row, at most
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * d, pa.int32()), pa.array(sums.reshape(-1, d)[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at]), flat], ["entry", "n", "sums"])

    found = planted.select("trees").mapInArrow(run, "entry long, n long, sums array<long>")
    found = found.select("entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # components of all codebooks
    out = books.reshape(-1, d).copy()
    for r in found:
        out[r.entry, r.place] = r.s // r.n
    return out.reshape(books.shape)


def coded(planted: DataFrame, books: np.ndarray) -> DataFrame:
    """row, code (two hex digits for each part), error (squared distances to the entries, summed over parts)."""
    parts = len(books)
    digits = np.array([f"{k:02x}".encode() for k in range(256)], "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            for i, blob in enumerate(batch.column("trees").to_pylist()):
                own = rows.slice(i, 1).flatten()
                text, error = np.empty((len(own), parts), "S2"), np.zeros(len(own), np.int64)
                for p, tree in enumerate(each_tree(blob, parts)):
                    code, _, _ = tree.assign(books[p])
                    text[:, p] = digits[code]
                    gap = tree.points - books[p][code[tree.order]]
                    error[tree.order] += (gap * gap).sum(1)
                yield pa.RecordBatch.from_arrays([own, pa.array(text.view(f"S{2 * parts}").ravel().astype(str)), pa.array(error)], ["row", "code", "error"])

    row = planted.schema["rows"].dataType.elementType
    return planted.mapInArrow(run, T.StructType([T.StructField("row", row), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def quantise(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", carry: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """A row for each vector that can be coded (row: a struct of its columns, or of those to carry; code; error), and the codebooks (part x entry x component)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)]).alias("row")
    rows = df.select(row, F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("x"))
    if df.schema[vector].dataType.simpleString() != "array<float>":  # floats are carried as such
        rows = rows.withColumn("x", F.col("x").cast("array<double>"))
    rows = rows.where(usable(F.col("x")))
    dim = (rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect() or [(parts,)])[0][0]
    if dim % parts:
        raise ValueError(f"{dim} components are not {parts} equal parts")
    rows = rows.where(F.size("x") == dim)
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    start = whole(np.array([r.x for r in first], float).reshape(len(first), dim), scale)
    books = np.stack(np.split(start, parts, 1))
    planted = trees(rows.select("row", "x"), parts, dim, scale)
    for _ in range(rounds if len(first) else 0):
        books = improved(planted, books)
    return coded(planted, books), books


def with_label_errors(codes: DataFrame, label: Column) -> DataFrame:
    """codes with label_error: errors summed over equal labels, nulls together. A label that very many rows share is looked up without moving them."""
    rows = materialise(codes.withColumn("label__", label), "codes")
    sums = materialise(rows.groupBy("label__").agg(F.sum("error").alias("label_error")), "label-errors")
    none = [r.label_error for r in sums.where("label__ is null").collect()]  # a row at most
    out = looked_up(rows, sums.where("label__ is not null"), "label__")
    return out.withColumn("label_error", F.coalesce("label_error", F.lit(none[0] if none else None).cast("long"))).drop("label__")
