"""Sharding by histogram sort: the law is `bytes`, shards of nearly equal size.

The sort key is (hash of the text, doc_id), so equal texts lie side by side. Probes
cut the key space; each round counts the exact rows and bytes below every probe over all rows, and only the intervals
in which a splitter must still lie get new probes, until each splitter is within the tolerance of its target. A boundary
between two groups of equal texts is preferred; a group too large for that is cut by doc_id. Then rows are exchanged
once, by ranges that are finer than shards, so that no shard has to fit in one task; slots come from the counts. Where rows
of one text and doc_id alone are too many for that (nulls, say), all rows are first written with numbers of their own,
and the number takes the place of doc_id in the key; so equal rows can be cut like any others.

Defined cases: a null text has no bytes and a size of 8, and its checksum is that of no bytes (0); a null doc_id sorts
first; rows that repeat key and text share a shard unless they alone outgrow it, and get slots of their own in any
order (any of them may lie in either of two shards that a group is cut into); a text too long for a shard's share is a shard's largest part all
the same, since only its size counts where shards are cut; fewer rows than shards leave shards empty; an empty table gives an empty result; other columns come along
(shard and slot as shard_in and slot_in).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

#: Share of a shard's bytes by which a boundary may miss its target.
TOLERANCE = 0.005
#: Share up to which a boundary between two groups of equal texts is taken, rather than one inside a group.
WHOLE_GROUPS = 0.02
#: New probes in each open interval a round.
PROBES = 48
#: Rows that a range of the final exchange should have at most.
RANGE_ROWS = 100_000

Key = tuple[int, int]
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def sizes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """k1 (hash of the text), k2 (key; null first), size."""
    return df.select(
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("k1"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOW)).alias("k2"), sizes(F.col(f"`{text}`")).alias("size"),
    )


def _below(k1: np.ndarray, k2: np.ndarray, probes: list[Key]) -> np.ndarray:
    """For each row, how many probes are at or below it (probes ascend)."""
    p1 = np.array([p[0] for p in probes], np.int64)
    p2 = np.array([p[1] for p in probes], np.int64)
    lo, hi = np.searchsorted(p1, k1, "left"), np.searchsorted(p1, k1, "right")
    for i in np.flatnonzero(hi > lo):  # rows whose hash is a probe's: few, or one group's
        lo[i] += np.searchsorted(p2[lo[i] : hi[i]], k2[i], "right")
    return lo


def counted(rows: DataFrame, probes: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """Exact rows and bytes below each probe, and in all: two arrays one longer than probes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, b = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for x in batches:
            at = _below(x.column(0).to_numpy(), x.column(1).to_numpy(), probes)
            n += np.bincount(at, minlength=len(n))
            np.add.at(b, at, x.column(2).to_numpy())
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(b[full])], ["bin", "n", "b"])

    n, b = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in rows.mapInArrow(count, "bin long, n long, b long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect():
        n[r.bin], b[r.bin] = r.n, r.b
    return np.cumsum(n), np.cumsum(b)


def _between(lo: Key, hi: Key, probes: int) -> list[Key]:
    """Probes strictly between two keys, evenly spread: by hash while whole groups lie between, then by key inside a group."""
    out: set[Key] = set()
    if hi[0] - lo[0] > 1:
        out = {(lo[0] + (hi[0] - lo[0]) * k // (probes + 1), LOW) for k in range(1, probes + 1)} | {(lo[0] + 1, LOW)}
    else:
        parts = [(lo[0], lo[1], hi[1])] if hi[0] == lo[0] else [(lo[0], lo[1], HIGH), (hi[0], LOW, hi[1])]
        for k1, a, b in parts:
            out |= {(k1, a)} | {(k1, a + (b - a) * k // (probes + 1)) for k in range(1, probes + 2)}
    return sorted(p for p in out if lo < p < hi)


def splitters(rows: DataFrame, parts: int, strict: float, whole: float, probes: int, known: dict[Key, tuple[int, int]]) -> list[Key]:
    """parts - 1 keys that cut the bytes evenly. A key is as near its target as strict (a share of a part), or as whole if only a group of
    equal texts lies between it and the target, or else no row lies between. known: exact (rows, bytes) below keys; it grows."""
    fresh = _between((LOW, LOW), (HIGH, HIGH), 24 * probes) if len(known) < 2 else []
    while True:
        if fresh:
            n, b = counted(rows, fresh)
            known |= {p: (int(n[k]), int(b[k])) for k, p in enumerate(fresh)} | {(LOW, LOW): (0, 0), (HIGH, HIGH): (int(n[-1]), int(b[-1]))}
        keys = sorted(known)
        below, total = np.array([known[k][1] for k in keys]), known[HIGH, HIGH][1]
        chosen, wanted = [], set()
        for t in (total * k // parts for k in range(1, parts)):
            i = min(int(np.searchsorted(below, t, "right")) - 1, len(keys) - 2)
            lo, hi = keys[i], keys[i + 1]
            near = min((lo, hi), key=lambda k: abs(known[k][1] - t))
            off = abs(known[near][1] - t) * parts
            chosen.append(near)
            one_group = hi[0] - lo[0] <= 1 and near[1] == LOW
            if off > strict * total and not (one_group and off <= whole * total) and known[hi][0] - known[lo][0] > 1:
                wanted.update(_between(lo, hi, probes))
        fresh = sorted(wanted - known.keys())
        if not fresh:
            return chosen


def uncut(known: dict[Key, tuple[int, int]], shards: int) -> bool:
    """Whether rows of one key are too many for a range, or outweigh what a shard may be off by."""
    keys, total = sorted(known), known[HIGH, HIGH]
    for lo, hi in zip(keys, keys[1:], strict=False):
        if hi[0] == lo[0] and hi[1] - lo[1] == 1:
            n, b = (known[hi][k] - known[lo][k] for k in (0, 1))
            if n > 1 and (n > RANGE_ROWS or b * shards > TOLERANCE * total[1]):
                return True
    return False


def shard(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows with `shard` and `slot` (from 0 in each shard), dealt out by ranges of the sort key: one exchange of whole rows."""
    columns = df.columns

    def ranges_of(rows: DataFrame) -> tuple[list[Key], list[Key], dict[Key, tuple[int, int]]]:
        known: dict[Key, tuple[int, int]] = {}
        cuts = splitters(rows, shards, TOLERANCE, WHOLE_GROUPS, PROBES, known)
        fine = shards * max(2, -(-known[HIGH, HIGH][0] // (RANGE_ROWS * shards)))
        return cuts, sorted({*cuts, *splitters(rows, fine, 0.2, 1.0, 4, known)} - {(LOW, LOW), (HIGH, HIGH)}), known

    cuts, bounds, known = ranges_of(materialise(keyed(df, key, text), "shard-keys"))
    if uncut(known, shards):
        key = next(c for k in range(len(columns) + 1) if (c := f"number_{k}") not in {x.lower() for x in columns})
        df = materialise(df.withColumn(key, F.monotonically_increasing_id()), "numbered")
        cuts, bounds, known = ranges_of(materialise(keyed(df, key, text), "shard-keys"))
    table, first = [], {}
    for k, at in enumerate([(LOW, LOW), *bounds]):
        s = sum(c <= at for c in cuts)
        below = known[at][0]
        table.append((k, s, below - first.setdefault(s, below)))

    def range_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(_below(k1.to_numpy(), k2.to_numpy(), bounds)).astype("int32")

    # all columns travel in one struct, so that their names can't clash with these
    ranges = df.sparkSession.createDataFrame(table, "r int, shard int, first long")
    out = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("k1"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOW)).alias("k2"),
    ).withColumn("r", F.pandas_udf(range_of, "int")("k1", "k2"))
    rank = F.row_number().over(Window.partitionBy("r").orderBy("k1", "k2"))
    out = out.withColumn("rank", rank.cast("long")).join(F.broadcast(ranges), "r")  # two rows a shard, or one for each RANGE_ROWS
    mine = [F.col(f"row.`{c}`").alias(c + "_in" if c.lower() in ("shard", "slot") else c) for c in columns]
    return out.select(*mine, "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))
