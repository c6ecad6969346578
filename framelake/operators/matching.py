"""Pairs of boxes inside a frame: overlaps, one-to-one matches, containment, clusters and boxes cut at tile seams.

Joins are equi-joins on the frame with the geometry as a residual condition. What is sequential inside a frame runs in
numpy over sorted frames, many in a task, as long as a frame has no more than CROWD boxes. Of larger ones no matrix is made:
their overlaps come from a join over grid cells, and what greedy matching or suppression would do box by box is done in
rounds over the table of overlaps. The order is strict (score, then pos), so what a box gets is settled as soon as no
unsettled box before it can touch it; a round settles all such boxes at once. When a frame has no more than FEW overlaps
left, one task ends it in order. Optimal assignment splits frames into connected parts of overlapping boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..sources.scratch import written
from .graphs import components

BOX = ("x1", "y1", "x2", "y2")
#: Boxes of a frame from which on it is no longer one task's matrix.
CROWD = 2_000
#: Frames of up to so many boxes are worked on together, a step of all at a time; larger ones one by one.
WIDTHS = (4, 8, 16, 32)
#: Overlaps of a frame that one task may end in order.
FEW = 1 << 20


def by_frame(df: DataFrame, keys: list[str], order: list[str], out: dict[str, str], many: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]) -> DataFrame:
    """keys and what `many` makes of some keys' rows (columns as arrays, in order, with each key's first row and the one after its last): rows whose keys it is for, and columns. Keys are hashed to tasks and sorted there, so a task streams over many frames; what it holds is a batch and the frame that the batch breaks off."""
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{k}` {t}" for k, t in out.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch])
            if rows is None or not len(rows):
                continue
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            n = len(rows)
            new = np.ones(n, bool)
            # two nulls are one key
            new[1:] = np.any([(columns[k][1:] != columns[k][:-1]) & ~(pd.isna(columns[k][1:]) & pd.isna(columns[k][:-1])) for k in keys], 0)
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], n)
            last = len(heads) if batch is None else len(heads) - 1
            held = None if batch is None else rows.iloc[heads[-1] :]
            if last:
                whole = {c: v[: ends[last - 1]] for c, v in columns.items()}
                at, made = many(whole, heads[:last], ends[:last])
                yield pd.DataFrame({k: whole[k][at] for k in keys} | {k: made[k] for k in out})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def corners(rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([rows[c] for c in BOX], 1).astype(float)


def prefixed(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(p + c) for c in df.columns if c not in keys])


def iou_pairs(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.0, strict: bool = True) -> DataFrame:
    """All pairs of one frame with their iou, above `least` (or at it, if not strict): columns a_*, b_*, iou."""
    pairs = prefixed(a, "a_", keys).join(prefixed(b, "b_", keys), keys).withColumn("iou", bx.iou("a_", "b_"))
    return pairs.where(F.col("iou") > least if strict else F.col("iou") >= least)


def iou_pairs_in_cells(a: DataFrame, b: DataFrame, keys: list[str], cell: float, least: float = 0.0) -> DataFrame:
    """iou_pairs for frames with very many boxes: only boxes that share a grid cell meet, and each pair once, in the first cell they share."""
    def cells(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return df.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))

    pairs = prefixed(cells(a), "a_", [*keys, "cx", "cy"]).join(prefixed(cells(b), "b_", [*keys, "cx", "cy"]), [*keys, "cx", "cy"])
    first = (F.col("cx") == F.floor(F.greatest("a_x1", "b_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y1", "b_y1") / cell))
    return pairs.where(first).withColumn("iou", bx.iou("a_", "b_")).where(F.col("iou") > least).drop("cx", "cy")


def crowds(boxes: DataFrame, keys: list[str], crowd: int | None = None) -> DataFrame | None:
    """Frames of more than CROWD boxes: keys, cell (the side of a grid cell: the mean box, or 1/64 of the largest); None without any."""
    side = F.greatest(bx.width(), bx.height())
    big = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg(side), F.max(side) / 64, F.lit(1e-9)).alias("cell"))
    big = big.where(F.col("n") > (CROWD if crowd is None else crowd)).drop("n")
    return written(big, "crowds") if big.limit(1).count() else None


def near_pairs(a: DataFrame, b: DataFrame, big: DataFrame, keys: list[str], least: float, carry: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Pairs of crowded frames whose iou is above 0 and at least `least`, found by cells: keys, a_* and b_* of what is carried, iou."""

    def cells(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("cell")), F.floor(F.col(hi) / F.col("cell"))))
        return prefixed(df.join(big, keys).withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2")), p, [*keys, "cx", "cy", "cell"])

    both = cells(a, "a_").join(cells(b, "b_").drop("cell"), [*keys, "cx", "cy"])
    at = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / F.col("cell"))
    both = both.where((F.col("cx") == at("x1")) & (F.col("cy") == at("y1"))).withColumn("iou", bx.iou("a_", "b_"))  # once, in the first cell that they share
    return both.where((F.col("iou") > 0) & (F.col("iou") >= least)).select(*keys, *[f"{p}_{c}" for p in "ab" for c in carry], "iou")


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(2)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def greedy(truth: np.ndarray, found: np.ndarray, score: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(truth, found, iou): boxes found, best score first (equal scores in order), each take the free truth that they overlap most (the first of equals)."""
    if not len(truth) or not len(found):
        return []
    overlap, free, out = iou_matrix(truth, found), np.ones(len(truth), bool), []
    for j in np.argsort(-score, kind="stable"):
        column = np.where(free, overlap[:, j], 0.0)
        i = int(column.argmax())
        if column[i] > 0 and column[i] >= least:
            free[i] = False
            out.append((i, int(j), float(column[i])))
    return out


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), as many as the smaller side has, of the greatest total gain."""
    return _augmented(gain)[0] if gain.size else []


def certified(gain: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Pairs (row, column) of positive gain with the greatest total, and potentials of rows and columns that prove it: none is negative,
    two add up to at least the gain of each pair, to exactly the gain of each pair taken, and whoever is in none has 0. Gains aren't negative."""
    n, m = gain.shape
    if not gain.size:
        return [], np.zeros(n), np.zeros(m)
    # with a column that nobody needs, some column stays free, so that no potential has to be negative
    wide = np.concatenate([gain, np.zeros((n, 1))], 1) if n <= m else np.concatenate([gain.T, np.zeros((m, 1))], 1)
    pairs, rows, columns = _augmented(wide)
    rows, columns = np.maximum(rows, 0.0), np.maximum(columns[:-1], 0.0)
    if n > m:
        pairs, rows, columns = [(j, i) for i, j in pairs], columns, rows
    return sorted((i, j) for i, j in pairs if i < n and j < m and gain[i, j] > 0), rows, columns


def _augmented(gain: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Shortest augmenting paths with potentials: pairs, potentials of rows and columns."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)  # 0: nobody
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            slack = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            nxt = 1 + int(np.where(done[1:], np.inf, least[1:]).argmin())
            step = least[nxt]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[back[at]], back[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    rows, columns = -u[1:], -v[1:]
    return (sorted((j, i) for i, j in pairs), columns, rows) if turned else (sorted(pairs), rows, columns)


def pieces(overlap: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a matrix's positive entries."""
    n, m = overlap.shape
    i, j = np.nonzero(overlap > 0)
    label = np.arange(n + m)
    while True:
        low = np.minimum(label[i], label[n + j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, n + j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(np.flatnonzero(label[:n] == k), np.flatnonzero(label[n:] == k)) for k in np.unique(label[i])]


def potentials(overlap: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """As certified(), part by part: only boxes that positive overlaps connect have to do with each other."""
    pairs, rows, columns = [], np.zeros(overlap.shape[0]), np.zeros(overlap.shape[1])
    for r, c in pieces(overlap):
        found, rows[r], columns[c] = certified(overlap[np.ix_(r, c)])
        pairs += [(int(r[i]), int(c[j])) for i, j in found]
    return sorted(pairs), rows, columns


def laid_out(heads: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small frames of about one size together: places of their rows (frames x boxes; a row's own first place where a frame has fewer), and which are boxes."""
    size, low = ends - heads, 0
    for width in WIDTHS:
        some = heads[(size > low) & (size <= width)]
        if len(some):
            n = size[(size > low) & (size <= width)]
            full = np.arange(width) < n[:, None]
            yield np.where(full, some[:, None] + np.arange(width), some[:, None]), full
        low = width


def overlaps(box: np.ndarray) -> np.ndarray:
    """iou_matrix of the boxes of each of some frames (frames x boxes x 4)."""
    a, b = box[:, :, None], box[:, None]
    wide, high = (np.clip(np.minimum(a[..., k + 2], b[..., k + 2]) - np.maximum(a[..., k], b[..., k]), 0, None) for k in (0, 1))
    inter = wide * high
    size = (box[..., 2] - box[..., 0]) * (box[..., 3] - box[..., 1])
    union = size[:, :, None] + size[:, None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def greedy_in_frames(is_truth: np.ndarray, box: np.ndarray, score: np.ndarray, heads: np.ndarray, ends: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the row that it is matched with (-1: none) and their iou: greedy() in each frame, small frames in step."""
    mate, iou = np.full(len(box), -1), np.zeros(len(box))
    for at, full in laid_out(heads, ends):
        truth, found, b = full & is_truth[at], full & ~is_truth[at], np.arange(len(at))
        gain = np.where(truth[:, :, None], overlaps(box[at]), 0.0)
        order = np.argsort(np.where(found, -score[at], np.inf), 1, kind="stable")
        for k in range(int(found.sum(1).max())):
            j = order[:, k]
            column = gain[b, :, j]
            i = column.argmax(1)
            best = column[b, i]
            ok = np.flatnonzero(found[b, j] & (best > 0) & (best >= least))
            t, f = at[ok, i[ok]], at[ok, j[ok]]
            mate[t], mate[f], iou[t], iou[f] = f, t, best[ok], best[ok]
            gain[ok, i[ok]] = 0.0  # taken
    for a, z in _large(heads, ends):
        t, f = a + np.flatnonzero(is_truth[a:z]), a + np.flatnonzero(~is_truth[a:z])
        for i, j, x in greedy(box[t], box[f], score[f], least):
            mate[t[i]], mate[f[j]] = f[j], t[i]
            iou[[t[i], f[j]]] = x
    return mate, iou


def _large(heads: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    big = ends - heads > WIDTHS[-1]
    return list(zip(heads[big].tolist(), ends[big].tolist(), strict=True))


def certified_in_frames(is_truth: np.ndarray, box: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the potential, the row assigned to it (-1: none) and their iou: certified() in each frame, small frames in step."""
    worth, mate, iou = np.zeros(len(box)), np.full(len(box), -1), np.zeros(len(box))
    for at, full in laid_out(heads, ends):
        sides = [full & is_truth[at], full & ~is_truth[at]]
        swap = (sides[0].sum(1) > sides[1].sum(1))[:, None]  # the smaller side is the rows
        row, column = np.where(swap, sides[1], sides[0]), np.where(swap, sides[0], sides[1])
        n, m = row.sum(1), column.sum(1)
        i, j = (np.argsort(~side, 1, kind="stable") for side in (row, column))
        i, j = i[:, : n.max()], j[:, : m.max()]
        b = np.arange(len(at))[:, None]
        gain = np.zeros((len(at), i.shape[1], j.shape[1] + 1))  # with a column that nobody needs
        gain[:, :, :-1] = np.where((row[b, i])[:, :, None] & (column[b, j])[:, None], overlaps(box[at])[b[:, :, None], i[:, :, None], j[:, None]], 0.0)
        owner, u, v = _augmented_in_step(gain, n)
        worth[at[b, i][row[b, i]]] = np.maximum(u, 0.0)[row[b, i]]
        worth[at[b, j][column[b, j]]] = np.maximum(v[:, :-1], 0.0)[column[b, j]]
        f, c = np.nonzero(owner[:, :-1] >= 0)
        x = gain[f, owner[f, c], c]
        f, c, x = f[x > 0], c[x > 0], x[x > 0]
        p, q = at[f, i[f, owner[f, c]]], at[f, j[f, c]]
        mate[p], mate[q], iou[p], iou[q] = q, p, x, x
    for a, z in _large(heads, ends):
        t, f = a + np.flatnonzero(is_truth[a:z]), a + np.flatnonzero(~is_truth[a:z])
        overlap = iou_matrix(box[t], box[f])
        pairs, worth[t], worth[f] = potentials(overlap)
        for i, j in pairs:
            mate[t[i]], mate[f[j]] = f[j], t[i]
            iou[[t[i], f[j]]] = overlap[i, j]
    return worth, mate, iou


def _augmented_in_step(gain: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_augmented() for matrices (frames x rows x columns, more columns than rows) of which the first `rows` count, a step of all at a time: each column's row (-1: none), potentials of rows and columns."""
    cost, (count, n, m) = -gain, gain.shape
    u, v, owner = np.zeros((count, n + 1)), np.zeros((count, m + 1)), np.zeros((count, m + 1), int)  # 0: nobody
    for row in range(1, n + 1):
        own = np.flatnonzero(rows >= row)
        owner[own, 0] = row
        at = np.zeros(count, int)
        least, back, done = np.full((count, m + 1), np.inf), np.zeros((count, m + 1), int), np.zeros((count, m + 1), bool)
        live = own
        while len(live):
            done[live, at[live]] = True
            past, near, now = done[live], least[live], owner[live, at[live]]
            slack = cost[live, now - 1] - u[live, now][:, None] - v[live, 1:]
            better = ~past[:, 1:] & (slack < near[:, 1:])
            near[:, 1:] = np.where(better, slack, near[:, 1:])
            back[live, 1:] = np.where(better, at[live][:, None], back[live, 1:])
            nxt = 1 + np.where(past[:, 1:], np.inf, near[:, 1:]).argmin(1)
            step = near[np.arange(len(live)), nxt]
            f, c = np.nonzero(past)
            u[live[f], owner[live[f], c]] += step[f]  # columns have different rows
            v[live] -= np.where(past, step[:, None], 0.0)
            least[live] = np.where(past, near, near - step[:, None])
            at[live] = nxt
            live = live[owner[live, nxt] != 0]
        live = own
        while len(live):
            to, come = at[live], back[live, at[live]]
            owner[live, to] = owner[live, come]
            at[live] = come
            live = live[come > 0]
    return owner[:, 1:] - 1, -u[:, 1:], -v[:, 1:]


def certificate(boxes: DataFrame, keys: list[str], crowd: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, is_truth, pos, potential, mate (the pos of the box assigned to it, or null), iou (with it), and corners to carry, of an optimal assignment and its proof, see certified(). A crowded frame is split into its connected parts, which are solved in tasks of their own."""

    def many(rows: dict[str, np.ndarray], heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        is_truth, pos = rows["is_truth"].astype(bool), rows["pos"]
        worth, mate, iou = certified_in_frames(is_truth, corners(rows), heads, ends)
        return np.arange(len(pos)), {"is_truth": is_truth, "pos": pos, "potential": worth, "mate": np.where(mate < 0, np.nan, pos[mate].astype(float)), "iou": iou} | {c: rows[c] for c in carry}

    def part(edges: pd.DataFrame) -> pd.DataFrame:
        t, i = np.unique(edges["a_pos"], return_inverse=True)
        f, j = np.unique(edges["b_pos"], return_inverse=True)
        gain = np.zeros((len(t), len(f)))
        gain[i, j] = edges["iou"]
        pairs, rows, columns = certified(gain)
        mate, iou = np.full(len(t) + len(f), np.nan), np.zeros(len(t) + len(f))
        for a, b in pairs:
            mate[a], mate[len(t) + b] = f[b], t[a]
            iou[[a, len(t) + b]] = gain[a, b]
        out = {k: edges[k].iloc[:1].repeat(len(mate)).to_numpy() for k in keys}
        return pd.DataFrame(out | {"is_truth": np.arange(len(mate)) < len(t), "pos": np.concatenate([t, f]), "potential": np.concatenate([rows, columns]), "mate": mate, "iou": iou})

    kinds = {"is_truth": "boolean", "pos": "long", "potential": "double", "mate": "double", "iou": "double"}
    tidy = lambda df: df.withColumn("mate", F.nanvl("mate", F.lit(None).cast("double")).cast("long"))
    small, big = _by_size(boxes.select(*keys, "pos", "is_truth", *BOX), keys, crowd)
    out = tidy(by_frame(small, keys, ["is_truth", "pos"], kinds | {c: dict(boxes.dtypes)[c] for c in carry}, many))
    if big is None:
        return out
    crowded = boxes.join(big.select(*keys), keys, "left_semi").select(*keys, "pos", "is_truth", *BOX)
    edges = written(near_pairs(crowded.where("is_truth"), crowded.where(~F.col("is_truth")), big, keys, 0.0), "overlaps")
    node = lambda side, pos: F.struct(*keys, F.lit(side).alias("side"), F.col(pos).alias("pos"))
    label = components(edges.select(node(0, "a_pos").alias("a"), node(1, "b_pos").alias("b")))
    parts = edges.withColumn("node", node(0, "a_pos")).join(label, "node").drop("node")
    schema = ", ".join([f"`{k}` {dict(boxes.dtypes)[k]}" for k in keys] + [f"{k} {t}" for k, t in kinds.items()])
    solved = tidy(parts.groupBy("label").applyInPandas(lambda g: part(g.drop(columns="label")), schema))
    alone = crowded.select(*keys, "is_truth", "pos", *carry).join(solved, [*keys, "is_truth", "pos"], "left")
    return out.unionByName(alone.select(*keys, "is_truth", "pos", F.coalesce("potential", F.lit(0.0)).alias("potential"), "mate", F.coalesce("iou", F.lit(0.0)).alias("iou"), *carry))


def _by_size(boxes: DataFrame, keys: list[str], crowd: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The boxes of frames that aren't crowded, and the crowded frames (None without any)."""
    big = crowds(boxes, keys, crowd)
    return (boxes if big is None else boxes.join(big.select(*keys), keys, "left_anti")), big


def _scored(df: DataFrame) -> DataFrame:
    """A missing score is 1.0."""
    return df.withColumn("score", F.coalesce(F.nanvl("score", F.lit(1.0)), F.lit(1.0)))


def greedy_in_rounds(boxes: DataFrame, big: DataFrame, keys: list[str], least: float, few: int | None = None) -> DataFrame:
    """keys, truth_pos, pos, iou: what greedy() gives in crowded frames. A box takes its best free truth once no unsettled box before it overlaps that truth enough: nobody can take it first then."""
    found = _scored(boxes.where(~F.col("is_truth")))
    live = near_pairs(boxes.where("is_truth").withColumn("score", F.lit(None).cast("double")), found, big, keys, least, ("pos", "score"))
    live = written(live.select(*keys, F.col("a_pos").alias("truth_pos"), F.col("b_pos").alias("pos"), F.col("b_score").alias("score"), "iou"), "overlaps")
    done = []

    def ended(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.assign(__s=-edges["score"], __i=-edges["iou"]).sort_values(["__s", "pos", "__i", "truth_pos"], kind="stable")
        taken, settled, keep = set(), set(), []
        for k, (t, p) in enumerate(zip(edges["truth_pos"], edges["pos"], strict=True)):
            if p not in settled and t not in taken:
                settled.add(p)
                taken.add(t)
                keep.append(k)
        return edges.iloc[keep][[*keys, "truth_pos", "pos", "iou"]]

    schema = ", ".join(f"`{k}` {t}" for k, t in live.dtypes if k != "score")
    while True:
        sizes = written(live.groupBy(*keys).agg((F.count(F.lit(1)) > (FEW if few is None else few)).alias("many")), "sizes")
        done.append(live.join(sizes.where(~F.col("many")), keys, "left_semi").groupBy(*keys).applyInPandas(ended, schema))
        live = live.join(sizes.where("many"), keys, "left_semi")
        if not sizes.where("many").limit(1).count():
            break
        first = live.groupBy(*keys, "truth_pos").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"))
        best = live.groupBy(*keys, "pos").agg(F.max(F.struct("iou", (-F.col("truth_pos")).alias("t"))).alias("m")).select(*keys, "pos", (-F.col("m.t")).alias("truth_pos"), "m.iou")
        settled = written(best.join(first, [*keys, "truth_pos", "pos"]), "settled")
        done.append(settled.select(*keys, "truth_pos", "pos", "iou"))
        live = written(live.join(settled.select(*keys, "truth_pos"), [*keys, "truth_pos"], "left_anti").join(settled.select(*keys, "pos"), [*keys, "pos"], "left_anti"), "overlaps")
    return _union([written(d, "matches").select(*keys, "truth_pos", "pos", "iou") for d in done])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def match(boxes: DataFrame, keys: list[str], least: float, how: str = "greedy", crowd: int | None = None) -> DataFrame:
    """keys, truth_pos, pos, iou: matches of each frame between truths (is_truth) and boxes found, in the order of pos: greedily, or (optimal) with the greatest total overlap, pairs under `least` going only after that."""
    if how == "optimal":
        both = certificate(boxes, keys, crowd).where(F.col("is_truth") & F.col("mate").isNotNull() & (F.col("iou") >= least))
        return both.select(*keys, F.col("pos").alias("truth_pos"), F.col("mate").alias("pos"), "iou")

    def many(rows: dict[str, np.ndarray], heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        is_truth, pos = rows["is_truth"].astype(bool), rows["pos"]
        mate, iou = greedy_in_frames(is_truth, corners(rows), np.nan_to_num(rows["score"].astype(float), nan=1.0), heads, ends, least)
        at = np.flatnonzero(~is_truth & (mate >= 0))
        return at, {"truth_pos": pos[mate[at]], "pos": pos[at], "iou": iou[at]}

    boxes = boxes.select(*keys, "pos", "is_truth", "score", *BOX)
    small, big = _by_size(boxes, keys, crowd)
    out = by_frame(small, keys, ["pos"], {"truth_pos": "long", "pos": "long", "iou": "double"}, many)
    return out if big is None else out.unionByName(greedy_in_rounds(boxes, big, keys, least))


def outcomes(boxes: DataFrame, keys: list[str], least: float, carry: list[str] = (), crowd: int | None = None) -> DataFrame:
    """A row for each box: keys, is_truth, score (missing: 1.0), taken (the score of the box found that is in its match, null if it is in none), and columns to carry.

    Boxes are matched greedily, best score first, so what a lower score threshold adds comes later and changes no earlier match: the matches at
    any threshold are those with at least that score.
    """
    kinds = dict(boxes.dtypes)

    def many(rows: dict[str, np.ndarray], heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        is_truth, score = rows["is_truth"].astype(bool), np.nan_to_num(rows["score"].astype(float), nan=1.0)
        mate, _ = greedy_in_frames(is_truth, corners(rows), score, heads, ends, least)
        taken = np.where(mate < 0, np.nan, np.where(is_truth, score[mate], score))
        return np.arange(len(score)), {"is_truth": is_truth, "score": score, "taken": taken} | {c: rows[c] for c in carry}

    boxes = boxes.select(*dict.fromkeys([*keys, "pos", "is_truth", "score", *BOX, *carry]))
    small, big = _by_size(boxes, keys, crowd)
    out = by_frame(small, keys, ["pos"], {"is_truth": "boolean", "score": "double", "taken": "double"} | {c: kinds[c] for c in carry}, many)
    out = out.withColumn("taken", F.nanvl("taken", F.lit(None).cast("double")))
    if big is None:
        return out
    crowded = _scored(boxes.join(big.select(*keys), keys, "left_semi"))
    pairs = greedy_in_rounds(crowded, big, keys, least).join(crowded.where(~F.col("is_truth")).select(*keys, "pos", F.col("score").alias("taken")), [*keys, "pos"])
    both = pairs.select(*keys, F.lit(True).alias("is_truth"), F.col("truth_pos").alias("pos"), "taken").unionByName(pairs.select(*keys, F.lit(False).alias("is_truth"), "pos", "taken"))
    return out.unionByName(crowded.join(both, [*keys, "is_truth", "pos"], "left").select(*keys, "is_truth", "score", "taken", *carry))


def containment(boxes: DataFrame, keys: list[str], track: str, part: float, ratio: float, cell: float = 64.0) -> DataFrame:
    """track, n, frac, container: in which share of its frames a track's box lies by `part` of its area in one at least `ratio` times as large, and most often whose (the smaller id of equals; of several in a frame the largest box, the first of equals).

    A box of which over half lies in another has its middle there, on both axes. So a box looks for containers in the one
    grid cell of its middle (for a smaller part, in all its cells), and containers stand in all their cells.
    """
    at = lambda x: F.floor(x / cell)
    span = lambda lo, hi: F.explode(F.sequence(at(F.col(lo)), at(F.col(hi))))
    cells = lambda df: df.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    rows = boxes.select(*keys, track, "pos", *BOX)
    middle = part > 0.5
    inner = rows.withColumns({"cx": at((F.col("x1") + F.col("x2")) / 2), "cy": at((F.col("y1") + F.col("y2")) / 2)}) if middle else cells(rows)
    on = [*keys, "cx", "cy"]
    pairs = prefixed(inner, "a_", on).join(prefixed(cells(rows), "b_", on), on).where(F.col("a_pos") != F.col("b_pos"))
    if not middle:  # once, in the first cell that both are in
        pairs = pairs.where((F.col("cx") == at(F.greatest("a_x1", "b_x1"))) & (F.col("cy") == at(F.greatest("a_y1", "b_y1"))))
    inside = pairs.where((bx.intersection("a_", "b_") / F.greatest(bx.area("a_"), F.lit(1.0)) >= part) & (bx.area("b_") >= ratio * bx.area("a_")))
    best = inside.groupBy(*keys, "a_pos", F.col(f"a_{track}").alias(track)).agg(F.max_by(f"b_{track}", F.struct(bx.area("b_"), -F.col("b_pos"))).alias("by"))
    hits = best.groupBy(track, "by").agg(F.count(F.lit(1)).alias("c"))
    total = hits.groupBy(track).agg(F.sum("c").alias("c"), F.max_by("by", F.struct("c", -F.col("by"))).alias("container"))
    n = boxes.groupBy(track).agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, track, "left").select(track, "n", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("frac"), "container")


def suppressed_in_rounds(boxes: DataFrame, big: DataFrame, keys: list[str], least: float, few: int | None = None) -> DataFrame:
    """keys, pos, head: what clusters() gives in crowded frames. A box that overlaps no unsettled box before it is a head, and what a head overlaps is none; who is nobody's is a head."""
    boxes = _scored(boxes)
    pairs = near_pairs(boxes, boxes, big, keys, least, ("pos", "score")).where((F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_pos") < F.col("b_pos"))))
    pairs = written(pairs.drop("iou"), "overlaps")  # a before b
    live, gone = pairs, []

    def ended(edges: pd.DataFrame) -> pd.DataFrame:
        """Boxes in order; each that no head before it has met is a head."""
        edges = edges.assign(__s=-edges["a_score"]).sort_values(["__s", "a_pos"], kind="stable")
        out: dict = {}
        for a, b in zip(edges["a_pos"], edges["b_pos"], strict=True):
            if a not in out:
                out.setdefault(b, None)
        return edges.iloc[:1][keys].merge(pd.DataFrame({"pos": list(out)}), how="cross")

    schema = ", ".join(f"`{k}` {t}" for k, t in pairs.select(*keys, F.col("a_pos").alias("pos")).dtypes)
    while True:
        sizes = written(live.groupBy(*keys).agg((F.count(F.lit(1)) > (FEW if few is None else few)).alias("many")), "sizes")
        gone.append(written(live.join(sizes.where(~F.col("many")), keys, "left_semi").groupBy(*keys).applyInPandas(ended, schema), "suppressed"))
        if not sizes.where("many").limit(1).count():
            break
        live = live.join(sizes.where("many"), keys, "left_semi")
        later = live.select(*keys, F.col("b_pos").alias("a_pos")).distinct()
        heads = live.select(*keys, "a_pos").distinct().join(later, [*keys, "a_pos"], "left_anti")
        met = written(live.join(heads, [*keys, "a_pos"], "left_semi").select(*keys, F.col("b_pos").alias("pos")).distinct(), "suppressed")
        gone.append(met)
        # whoever is suppressed touches nobody any more
        left = live.join(met.withColumnRenamed("pos", "a_pos"), [*keys, "a_pos"], "left_anti").join(met.withColumnRenamed("pos", "b_pos"), [*keys, "b_pos"], "left_anti")
        live = written(left.select(*pairs.columns), "overlaps")
    none = _union(gone).distinct()
    heads = pairs.join(none.withColumnRenamed("pos", "a_pos"), [*keys, "a_pos"], "left_anti")
    own = heads.groupBy(*keys, F.col("b_pos").alias("pos")).agg(F.max_by("a_pos", F.struct("a_score", -F.col("a_pos"))).alias("head"))
    return boxes.select(*keys, "pos").join(own, [*keys, "pos"], "left").withColumn("head", F.coalesce("head", "pos"))


def clusters(boxes: DataFrame, keys: list[str], least: float, crowd: int | None = None) -> DataFrame:
    """keys, pos, head: greedy suppression, best score first; each cluster bears the place of its head. least: above 0."""
    if least <= 0:
        raise ValueError("boxes that don't overlap are in no cluster")

    def many(rows: dict[str, np.ndarray], heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        box, score, pos = corners(rows), np.nan_to_num(rows["score"].astype(float), nan=1.0), rows["pos"]
        head = np.full(len(pos), -1)
        for at, full in laid_out(heads, ends):  # small frames in step
            b, near, own = np.arange(len(at)), overlaps(box[at]) >= least, np.where(full, -1, -2)
            order = np.argsort(np.where(full, -score[at], np.inf), 1, kind="stable")
            for k in range(at.shape[1]):
                i = order[:, k]
                ok = np.flatnonzero(own[b, i] == -1)
                own[ok] = np.where((own[ok] == -1) & near[ok, i[ok]], i[ok, None], own[ok])
                own[ok, i[ok]] = i[ok]
            f, c = np.nonzero(full)
            head[at[f, c]] = at[f, own[f, c]]
        for a, z in _large(heads, ends):
            overlap, own = iou_matrix(box[a:z], box[a:z]), np.full(z - a, -1)
            for i in np.argsort(-score[a:z], kind="stable"):
                if own[i] < 0:
                    own[(own < 0) & (overlap[i] >= least)] = i
                    own[i] = i
            head[a:z] = a + own
        return np.arange(len(pos)), {"pos": pos, "head": pos[head]}

    boxes = boxes.select(*keys, "pos", "score", *BOX)
    small, big = _by_size(boxes, keys, crowd)
    out = by_frame(small, keys, ["pos"], {"pos": "long", "head": "long"}, many)
    return out if big is None else out.unionByName(suppressed_in_rounds(boxes.join(big.select(*keys), keys, "left_semi"), big, keys, least))


def rejoin(boxes: DataFrame, keys: list[str], bands: tuple[list[tuple[int, int]], list[tuple[int, int]]], tolerance: float, least: float) -> DataFrame:
    """keys, pos, piece_of: boxes that seams of tiles cut, with the least place of their group (groups of two and more).

    bands: for each axis the (start of the next tile, end of this one) of every seam. Boxes that end at a seam meet those that
    start at it by a join on frame and seam; groups are the connected components of what fits together.
    """
    sides = []
    for axis, seams in enumerate(bands):
        lo, hi, other = ("x1", "x2", ("y1", "y2")) if axis == 0 else ("y1", "y2", ("x1", "x2"))
        for k, (start, end) in enumerate(seams):
            near = lambda c, to: F.abs(F.col(c) - to) <= tolerance
            kind = F.array_compact(F.array(F.when(near(hi, end) & (F.col(lo) < start), "ends"), F.when(near(lo, start) & (F.col(hi) > end), "starts")))
            sides.append(F.struct(F.lit(axis).alias("axis"), F.lit(k).alias("seam"), kind.alias("kinds"), F.col(other[0]).alias("from"), F.col(other[1]).alias("to")))
    if not sides:
        return boxes.select(*keys, "pos", F.col("pos").alias("piece_of")).limit(0)
    cut = boxes.select(*keys, "pos", F.explode(F.array(*sides)).alias("s")).select(*keys, "pos", "s.axis", "s.seam", F.explode("s.kinds").alias("kind"), "s.from", "s.to")
    on = [*keys, "axis", "seam"]
    a, b = (prefixed(cut.where(F.col("kind") == k).drop("kind"), p, on) for k, p in (("ends", "a_"), ("starts", "b_")))
    union, inter = F.greatest("a_to", "b_to") - F.least("a_from", "b_from"), F.least("a_to", "b_to") - F.greatest("a_from", "b_from")
    fits = a.join(b, on).where((union > 0) & (inter / union >= least) & (F.col("a_pos") != F.col("b_pos")))
    node = lambda c: F.struct(*keys, F.col(c).alias("pos"))
    found = components(written(fits.select(node("a_pos").alias("a"), node("b_pos").alias("b")), "seams"))
    return found.select("node.*", F.col("label.pos").alias("piece_of"))
