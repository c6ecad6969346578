"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of at most `capacity` tokens. What a packing needs to know of them is how many pieces there are
of each length: a histogram of at most `capacity` numbers, exact over all rows, however many. On it, sets that provably
dominate every other set with their longest member are fixed for good (for all copies of such a set at once), which
shrinks the instance; the remainder is packed best-fit decreasing. The outcome is a list of patterns with how often each
is used. A piece then finds its place by its rank among the pieces of its length, which comes from counts by task and
length, so no length needs to fit in one task.

Defined cases: a null text is the empty one, whose single piece is the end id; pieces are cut so that only a document's
first piece is shorter than the capacity; a document of exactly the capacity is one piece; repeated rows are packed as
rows of their own; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import bpe
from .scratch import materialise

Pattern = tuple[int, ...]


def dominant(left: list[int], counts: list[int], s: int, capacity: int) -> Pattern | None:
    """The companions of s in a set that dominates all sets with s, if the criterion finds one. left: sizes that are left, ascending, without one s."""
    room = capacity - s
    if not left or left[0] > room:
        return ()
    k = left[bisect_right(left, room) - 1]
    small = []
    for x in left:  # the smallest three, as often as they occur
        small += [x] * min(3, counts[x])
        if len(small) >= 3:
            break
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return (k,)
    if len(small) >= 3 and sum(small[:3]) <= room:
        return None
    # at most two go with s: the best pair
    best, pair = 0, None
    for i in range(bisect_right(left, room) - 1, -1, -1):
        a = left[i]
        j = bisect_right(left, min(a, room - a)) - 1
        if j >= 0 and left[j] == a and counts[a] < 2:
            j -= 1
        if j >= 0 and a + left[j] > best:
            best, pair = a + left[j], (a, left[j])
        if 2 * a < best:
            break
    if best <= k:
        return (k,)
    if pair and pair[0] == k and best == room:
        # any other pair must fit in the places of this one
        above = left[bisect_right(left, pair[1]) :]
        if not above or above[0] + (above[0] if counts[above[0]] > 1 else (above[1] if len(above) > 1 else capacity)) > room:
            return pair
    return None


def reduce(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets; counts (by size) becomes what remains."""
    fixed = []
    again = True
    while again:
        again = False
        for s in range(capacity, 0, -1):
            while counts[s]:
                counts[s] -= 1
                left = [x for x in range(1, capacity + 1) if counts[x]]
                more = dominant(left, counts, s, capacity)
                counts[s] += 1
                if more is None:
                    break
                whole = (s, *more)
                # with fewer pieces left the set still dominates, so all copies of it are fixed at once
                n = min(counts[x] // whole.count(x) for x in set(whole))
                for x in whole:
                    counts[x] -= n
                fixed.append((whole, n))
                again = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, all equal bins at once."""
    open_: dict[int, list[list]] = {}
    for s in range(capacity, 0, -1):
        n = counts[s]
        while n and (rooms := [r for r in open_ if r >= s]):
            group = open_[room := min(rooms)]
            pattern, have = group[-1]
            t = min(n, have)
            if t == have:
                group.pop()
                if not group:
                    del open_[room]
            else:
                group[-1][1] -= t
            open_.setdefault(room - s, []).append([(*pattern, s), t])
            n -= t
        each = capacity // s
        for k, many in ((each, n // each), (n % each, 1)):
            if k and many:
                open_.setdefault(capacity - k * s, []).append([(s,) * k, many])
    return [(p, n) for group in open_.values() for p, n in group]


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    counts = [0] * (capacity + 1)
    for size, n in histogram.items():
        counts[size] = n
    fixed = reduce(counts, capacity)
    return fixed + best_fit(counts, capacity)


class Places:
    """Where the r-th piece of a length goes: arrays as long as the patterns, whatever the number of pieces."""

    def __init__(self, found: list[tuple[Pattern, int]], capacity: int):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for pattern, n in found:
            at = 0
            for s in pattern:
                slots.setdefault(s, []).append((n, base, at))
                at += s
            base += n
        self.sequences = base
        order = [(s, *x) for s in sorted(slots) for x in slots[s]]
        self.n = np.array([x[1] for x in order], np.int64)
        self.base = np.array([x[2] for x in order], np.int64)
        self.at = np.array([x[3] for x in order], np.int64)
        self.until = np.cumsum(self.n)
        self.before = np.zeros(capacity + 2, np.int64)  # pieces shorter than that
        for s in slots:
            self.before[s + 1] = sum(x[0] for x in slots[s])
        self.before = np.cumsum(self.before)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.before[length] + rank
        k = np.searchsorted(self.until, r, "right")
        return self.base[k] + r - (self.until[k] - self.n[k]), self.at[k]


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces, with a length from 1 to capacity, and `task` and `rank` (its place among that task's pieces of this length): with sequence_id, offset.

    pieces must be a written table: the numbers hold only as long as rows keep their task and rank.
    """
    own = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = own.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = Places(patterns(histogram, capacity), capacity)

    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, at = places.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    place = F.pandas_udf(find, "sequence_id long, offset long")
    rest = [c for c in pieces.columns if c not in ("task", "rank")]
    return pieces.join(before, ["length", "task"]).select(*rest, place("length", F.col("rank") + F.col("before")).alias("place")).select(*rest, "place.*")


def ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's place among those of its length, after `seen` (by length), which goes on counting."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(length))
    out = np.empty(len(length), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0)) + seen[ordered]
    np.add.at(seen, length, 1)
    return out


def token_pieces(df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' pieces, written: key, piece, start, length, ids_crc32, task, rank (and ids, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = bpe.load(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for block in B.blocks(batches, "text", B.BLOCK_BYTES // 2):
            ids, count = coder.encode(*B.buffers(block.column("text")))
            ends = np.cumsum(count)
            ids = np.insert(ids, ends, end_id)
            size = count + 1
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = B.ragged(np.zeros(len(n), np.int64), n)
            short = size - (n - 1) * capacity  # of the first piece
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[doc], capacity)
            flat = memoryview(ids.astype("<u4")).cast("B")
            upto = np.cumsum(length) * 4
            crc = [zlib.crc32(flat[z - 4 * k : z]) for z, k in zip(upto.tolist(), length.tolist(), strict=True)]
            columns = [block.column("key").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(ranks(length, seen))]
            if with_ids:
                columns.append(B.binary_of(np.frombuffer(flat, np.uint8), length * 4).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * with_ids
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
    return materialise(out, "pieces").withColumnRenamed("key", key)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each piece with its sequence and its place there."""
    return pack(token_pieces(df, tokenizer, end_id, capacity, key, text, with_ids), capacity)
