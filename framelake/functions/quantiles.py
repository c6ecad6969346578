"""Four definitions of a percentile that must not be mixed up, exact in groups of any size.

`linear` is Spark's own. The others ask for values at ranks, which `ranked` finds by distributed selection: sketches of all
groups give probes on both sides of each rank, one pass counts exactly what lies below, at and between the probes, and the
interval that holds the rank goes into the next pass, until it has no more rows than a task may sort (or one value). All
passes are aggregations with map-side sums; no group is ever sorted or ranked as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of an interval that are sorted in one task.
LEAST = 20_000
#: Probes of a pass, and the accuracy of the sketch that they come from.
GRID, ACCURACY = 200, 10_000
#: Groups with more than one in so many of all rows (there are fewer of them than this) meet their rows where these lie.
HOT = 100_000


def linear(x: Column, p: float) -> Column:
    """Linear interpolation between the nearest ranks."""
    return F.percentile(x, F.lit(p))


def ranked(df: DataFrame, keys: list[str], x: str, places: Callable[[Column], list[Column]], least: int | None = None) -> DataFrame:
    """keys, n (rows of the group), place, value: for each group and each of places(n), which are ranks from 0, the value at that rank. Nulls don't count, ranks outside a group give no row, a null key is a key, NaN is larger than any number."""
    least = LEAST if least is None else least
    names = [f"k{i}__" for i in range(len(keys))]
    values = df.where(F.col(x).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(x).alias("x__"))
    kind = values.schema["x__"].dataType
    none = F.lit(None).cast(kind)
    sizes = values.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    state = sizes.select(*names, "n", F.posexplode(F.array(*[p.cast("long") for p in places(F.col("n"))])).alias("place", "rank")).where("rank >= 0 and rank < n")
    # what is known: the rank-th of `rows` values strictly between lo and hi (null: no bound); or the value itself
    state = written(state.select(*names, "n", "place", "rank", F.col("n").alias("rows"), none.alias("lo"), none.alias("hi"), none.alias("value")), "ranks")
    parts, columns = [], state.columns
    while True:
        parts.append(state.where((F.col("rows") <= least) | F.col("value").isNotNull()))
        wide = state.where((F.col("rows") > least) & F.col("value").isNull())
        if not wide.limit(1).count():
            break
        state = written(_narrowed(values, wide, names, columns), "ranks")
    known = parts[0]
    for part in parts[1:]:
        known = known.unionByName(part)
    short = _between(values, known.where(F.col("value").isNull()), names).groupBy(*columns).agg(F.sort_array(F.collect_list("x__")).alias("s"))  # LEAST values at most
    found = short.select(*names, "n", "place", F.element_at("s", (F.col("rank") + 1).cast("int")).alias("value")).unionByName(known.where(F.col("value").isNotNull()).select(*names, "n", "place", "value"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "n", "place", "value")


def _between(values: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """The values inside each interval, with the interval's columns."""
    mine = state.select(*[F.col(n).alias(f"own_{n}") for n in names], *[c for c in state.columns if c not in names])
    same = (F.col("lo").isNull() | (F.col("x__") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x__") < F.col("hi")))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"own_{n}"))
    size = mine.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    fair = (size[0] or 0) // HOT  # at most HOT groups have more rows than this
    hot, rest = F.broadcast(mine.where(F.col("n") > fair)), mine.where(F.col("n") <= fair)
    if (size[2] or 1) > fair:
        return values.join(hot, same)
    return values.join(rest, same) if size[1] <= fair else values.join(hot, same).unionByName(values.join(rest, same))


def _narrowed(values: DataFrame, wide: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Intervals after one pass: each has fewer rows than before, as a probe is a value inside it and lies in none of the new ones."""
    sketch = _between(values, wide, names).groupBy(*columns).agg(F.percentile_approx("x__", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("q"))
    at = F.floor(F.col("rank") * GRID / F.col("rows"))
    probe = lambda k: F.element_at("q", (F.greatest(F.lit(0), F.least(F.lit(GRID), k)) + 1).cast("int"))
    probed = written(sketch.select(*columns, probe(at - 1).alias("a"), probe(at + 2).alias("b")), "probes")
    x, a, b = F.col("x__"), F.col("a"), F.col("b")
    counted = _between(values, probed, names).groupBy(*columns, "a", "b").agg(
        F.count_if(x < a).alias("under"), F.count_if(x == a).alias("at_a"), F.count_if((x > a) & (x < b)).alias("mid"), F.count_if((x == b) & (b > a)).alias("at_b")
    )
    # where the rank falls: below a, at a, between, at b, above b
    c = F.col
    steps = [c("under"), c("under") + c("at_a"), c("under") + c("at_a") + c("mid"), c("under") + c("at_a") + c("mid") + c("at_b")]
    pick = lambda *v: F.when(c("rank") < steps[0], v[0]).when(c("rank") < steps[1], v[1]).when(c("rank") < steps[2], v[2]).when(c("rank") < steps[3], v[3]).otherwise(v[4])
    none = F.lit(None).cast(wide.schema["lo"].dataType)
    out = {
        "lo": pick(c("lo"), c("lo"), a, c("lo"), b), "hi": pick(a, c("hi"), b, c("hi"), c("hi")), "value": pick(none, a, none, b, none),
        "rows": pick(c("under"), c("rows"), c("mid"), c("rows"), c("rows") - steps[3]), "rank": pick(c("rank"), c("rank"), c("rank") - steps[1], c("rank"), c("rank") - steps[3]),
    }
    return counted.select(*[out.get(k, c(k)).alias(k) for k in columns])


def rank_at(df: DataFrame, keys: list[str], x: str, index: Callable[[Column], Column]) -> DataFrame:
    """keys and `value`: the index-th smallest x (from 0; index(n): a column of the group's size)."""
    return ranked(df, keys, x, lambda n: [index(n)]).select(*keys, "value")


def floor_of_last(n: Column, p: float) -> Column:
    """Definition (a): the place int(p * (n - 1))."""
    return F.floor(F.lit(p) * (n - 1))


def floor_of_count(n: Column, p: float) -> Column:
    """Definition (b): the place int(n * p); with p = 0.5 it is the upper median."""
    return F.floor(n * F.lit(p))


def exclusive(df: DataFrame, keys: list[str], x: str, p: float, more_than: int = 10) -> DataFrame:
    """keys and `value`: definition (c), interpolated at p * (n + 1), null unless a group has more than `more_than` values."""
    at = lambda n: F.lit(p) * (n + 1)
    low = lambda n: F.greatest(F.lit(1), F.least(F.floor(at(n)), n - 1))
    # too small a group gives its first value twice, so that it has a row
    both = ranked(df, keys, x, lambda n: [F.when(n > more_than, low(n) - 1).otherwise(0), F.when(n > more_than, low(n)).otherwise(0)])
    pair = both.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("place") == k, F.col("value"))).alias(f"v{k}") for k in (0, 1)])
    n = F.col("n")
    return pair.select(*keys, F.when(n > more_than, F.col("v0") + (at(n) - low(n)) * (F.col("v1") - F.col("v0"))).alias("value"))
