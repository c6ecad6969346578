"""Deterministic samples: order inside a cell comes from a hash of the row's key, so a sample is the same on every run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import evenly


def by_cells(df: DataFrame, group: str, cell: str, cap: int, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """At most `cap` rows of each group, spread over its cells: max(1, cap // cells) of each.

    No cell gives more than `cap` rows, a number known beforehand: so each task sends its own first rows of a cell only.
    """
    w = Window.partitionBy(group, cell).orderBy(*(order or [F.xxhash64(*key)]), *key)
    first = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(1, cap))
    cells = F.size(F.collect_set(cell).over(Window.partitionBy(group)))  # each cell is still there
    return first.withColumn("__cells", cells).where(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("__cells")))).drop("__r", "__cells")


def by_tracks(df: DataFrame, group: str, track: str, order: list[str], k: int, cap: int, draw: Column | None = None) -> DataFrame:
    """At most k evenly spaced rows of each track and about `cap` of each group: with too many tracks, those with the least hash.

    Of a group's tracks no more than `cap` can be drawn, and each task sends its own first ones only; how many tracks there are is counted apart.
    """
    tracks = df.select(group, track).distinct()
    n = tracks.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__n"))  # a row a group
    w = Window.partitionBy(group).orderBy(F.xxhash64(track) if draw is None else draw, track)
    first = tracks.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(1, cap))
    first = first.join(n, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    each = F.greatest(F.lit(1), F.least(F.lit(k), F.floor(F.lit(cap) / F.col("__n"))))
    first = first.withColumn("__k", each.cast("int")).where((F.col("__n") * F.col("__k") <= cap) | (F.col("__r") <= F.floor(F.lit(cap) / F.col("__k")))).drop("__n", "__r")
    return evenly(df.join(first, [group, track]), [group, track], order, F.col("__k")).drop("__k")


def by_strata(df: DataFrame, strata: list[tuple[str, int, Column]], key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Quotas of strata in their order; a row belongs to the first stratum that it fits and that has not filled up before. Columns of df and stratum.

    The strata before one can take no more than their quotas from it, so the first sum-of-quotas rows of each are all that can matter: these
    come from one pass, and are no more than strata times quotas, whatever the table's size. They are dealt out by one task.
    """
    names, quotas = [s[0] for s in strata], [s[1] for s in strata]
    sums = np.cumsum(quotas).tolist()
    place = [F.when(F.coalesce(fits, F.lit(False)), F.lit(i)) for i, (_, _, fits) in enumerate(strata)]
    rows = df.withColumn("__s", F.explode(F.array_compact(F.array(*place))))
    w = Window.partitionBy("__s").orderBy(*(order or [F.xxhash64(*key)]), *key)
    upto = F.element_at(F.array(*map(F.lit, sums)), F.col("__s") + 1)
    few = rows.withColumn("__d", F.pmod(F.xxhash64(*key), F.lit(64)))  # in pieces first, so that no task ranks a whole stratum
    few = few.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__d").orderBy(*(order or [F.xxhash64(*key)]), *key))).where(F.col("__r") <= upto)
    few = few.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= upto).drop("__d")

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        taken, keep, left = set(), [], list(quotas)
        rows = rows.sort_values(["__s", "__r"], kind="stable").reset_index(drop=True)
        for i, (s, *k) in enumerate(zip(rows["__s"], *(rows[c] for c in key), strict=True)):
            if left[s] and tuple(k) not in taken:
                taken.add(tuple(k))
                left[s] -= 1
                keep.append(i)
        out = rows.loc[keep].drop(columns=["__r", "__g"])
        return out.assign(stratum=[names[s] for s in out.pop("__s")])

    return few.withColumn("__g", F.col("__s") * 0).groupBy("__g").applyInPandas(deal, f"{df._jdf.schema().toDDL()}, stratum string")


def diverse(df: DataFrame, stratum: list[str], quota: int, source: str, buckets: list[str], key: list[str], draw: Column | None = None) -> DataFrame:
    """Greedy draw of `quota` rows a stratum: each row repeats source (twice the weight) and buckets of those drawn before as little as can be; ties by hash order (or draw). Strata are drawn one apart from the other. Columns of df and `draw`.

    Rows of one source and the same buckets cost the same, so of each such cell only the first `quota` can be drawn; no more reach the loop.
    """
    hashed = df.withColumn("__h", F.xxhash64(*key) if draw is None else draw)
    cell = Window.partitionBy(*stratum, source, *buckets).orderBy("__h", *key)
    hashed = hashed.withColumn("__r", F.row_number().over(cell)).where(F.col("__r") <= quota).drop("__r")
    schema = f"{df._jdf.schema().toDDL()}, draw int"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__h", *key], kind="stable").reset_index(drop=True)
        cost = np.zeros(len(group))
        columns = [(group[c].to_numpy(), weight) for c, weight in [(source, 2.5), *((b, 1.0) for b in buckets)]]
        picked = []
        for _ in range(min(quota, len(group))):
            i = int(cost.argmin())
            picked.append(i)
            for values, weight in columns:
                cost += weight * (values == values[i])
            cost[picked] = np.inf
        out = group.loc[picked].drop(columns="__h")
        out["draw"] = range(len(picked))
        return out

    return hashed.groupBy(*stratum).applyInPandas(one, schema)


def lattice(key: list[str | Column], seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the integer key alone, in arithmetic that any SQL has (`chance` is the better mixed one)."""
    h = F.lit(seed + 1).cast("long")
    for k in key:
        h = (h * 48271 + F.col(k) * 69621 + 1) % 2147483647 if isinstance(k, str) else (h * 48271 + k * 69621 + 1) % 2147483647
    return (h * 48271 % 2147483647 * 69621 % 2147483647) / F.lit(2147483647.0)


def chance(key: list[str], seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
