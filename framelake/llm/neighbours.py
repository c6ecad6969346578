"""Approximate nearest neighbours by learned partitions (largest inner product).

On a bounded sample a graph of nearest neighbours is cut into balanced parts: medians along principal directions first,
then nodes move to where most of their neighbours are while parts keep their size. A small classifier learns the parts
and places every vector of the index; another, trained on where neighbours were placed, gives each query its most
probable parts. There are about as many parts as a part has vectors, up to one for LEARN_PART vectors of the sample, which
must tell them apart; only tables of 2 * k candidates or fewer are one part. How many are opened is the least number that
finds RECALL of the neighbours of sample vectors held out from training; where the table is larger than the sample, their
neighbours too are vectors that no classifier learned from (half as many again), as those it learned are placed better than others. Beyond SAMPLE / LEARN_PART parts a part grows with the table; one with more than LEAF vectors is divided
itself, by its own sample, cut and classifiers, which one task learns from the part's sample and from sampled queries that
open the part; their model then meets the part's vectors and queries in cells. So it goes on for DEEP levels, or until
no part is as large; what can't be divided (equal vectors) is searched in cells of VECTORS. RECALL is then shared among the
levels that the size of the table asks for; a part that is large for another reason is divided at a recall of SURE. Opened parts are searched exactly: the score is the inner product in double precision, summed in the order of
components.

Defined cases: vectors null, empty, zero, of another length than most, or with null or non-finite components take no
part; a query's own vec_id is no candidate; ties go to the smaller id; fewer candidates than k give all of them; rows
that repeat an id count as one, that with the least hash of its vector; equal vectors have equal scores wherever they
lie; a null id takes no part; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Vectors that the classifier learns from, at most; half as many more tell how many parts to open.
SAMPLE = 12_000
#: Vectors of the sample that a part needs.
LEARN_PART = 25
RECALL, SURE = 0.93, 0.99
#: Vectors, and queries, of a cell of the search.
VECTORS, QUERIES = 1 << 15, 1 << 13
#: Vectors not learned from that are enough to tell how many parts to open.
FEW = 50
#: Scores worked on at once.
SCORES = 1 << 22
#: Vectors of a part that is not divided again, levels below the first, and more than the parts of one division.
LEAF, DEEP, WIDE = 2048, 3, 512


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def stacked(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_list()).astype(float)


def nearest(q: np.ndarray, x: np.ndarray, k: int, own: bool, ids: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Indices of the k largest inner products, in no order; own: a row of x with the id of the query doesn't count
    (without ids, of q and x: row i of q is row i of x)."""
    out = np.empty((len(q), min(k, len(x) - own)), np.int64)
    for a in range(0, len(q), 512):
        s = q[a : a + 512] @ x.T
        if own and ids:
            s[ids[0][a : a + 512][:, None] == ids[1][None, :]] = -np.inf
        elif own:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def cut(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Balanced parts of a neighbour graph (row i: the neighbours of node i)."""
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, base, k = todo.pop()
        part[rows] = base
        if k > 1:
            y = x[rows] - x[rows].mean(0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = rows[np.argsort(y @ axis, kind="stable")]
            left = k // 2
            at = len(rows) * left // k
            todo += [(order[:at], base, left), (order[at:], base + left, k - left)]
    room = int(np.ceil(1.1 * n / parts))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], 1)
    for _ in range(rounds):
        near = np.bincount(both[0] * parts + part[both[1]], minlength=n * parts).reshape(n, parts)
        want = near.argmax(1)
        gain = near[np.arange(n), want] - near[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < n // 200:
            break
    return part


class Net:
    """One hidden layer; trained to a distribution over parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.scale = float(np.sqrt((x * x).mean())) or 1.0
        x = (x / self.scale).astype(np.float32)
        d, k = x.shape[1], target.shape[1]
        w = self.w = [(rng.standard_normal((d, hidden)) / np.sqrt(d)).astype(np.float32), np.zeros(hidden, np.float32), (rng.standard_normal((hidden, k)) / np.sqrt(hidden)).astype(np.float32), np.zeros(k, np.float32)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 128):
                rows = order[a : a + 128]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                p = self._soft(h @ w[2] + w[3])
                g = (p - target[rows]) / len(rows)
                dh = (g @ w[2].T) * (h > 0)
                t += 1
                for i, grad in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ g, g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    w[i] -= 0.003 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        return np.maximum((x / self.scale).astype(np.float32) @ w[0] + w[1], 0) @ w[2] + w[3]


class Index:
    """What places vectors and routes queries. sample: vectors in rows, of which the first `learned` are learned from (the others
    tell how many parts to open); rows: how many the index will hold; asked: ids of the sample, and ids and vectors of queries
    that come from elsewhere as well, if the sample isn't drawn from all of them."""

    def __init__(self, sample: np.ndarray, rows: int, k: int = 20, recall: float = RECALL, asked: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, learned: int = SAMPLE):
        sample, unseen = sample[:learned], sample[learned:]
        self.parts = 1 if rows <= 2 * k else max(1, min(round(math.sqrt(rows)), len(sample) // LEARN_PART))
        self.probes = 1
        if self.parts == 1 or not (sample != sample[0]).any():
            self.parts = 1
            return
        x = sample.astype(np.float32)
        graph = nearest(x, x, min(12, len(x) - 1), True)
        part = cut(x, graph, self.parts)
        self.place = Net(x, 0.7 * self.shares(part[:, None]) + 0.3 * self.shares(part[graph]))
        placed = self.parts_of(x)
        # as many neighbours as k of the whole index are in a sample of it, but no fewer than a few
        some = max(8, round(k * len(x) / max(rows, len(x))))
        near, q = nearest(x, x, some, True), x
        learn = np.arange(len(x)) % 10 != 9
        if asked and len(asked[1]):
            q = np.concatenate([x, asked[2].astype(np.float32)])
            near = np.concatenate([near, nearest(q[len(x) :], x, some, True, (asked[1], asked[0][:learned]))])
            # queries stop where queries find enough, if there are enough of them to tell
            learn = np.append(learn | (len(asked[1]) >= 60), np.arange(len(asked[1])) % 3 != 2)
        self.route = Net(q[learn], self.shares(placed[near[learn]]))
        test, to = q[~learn], placed[near[~learn]]
        if len(unseen) >= FEW:
            y, few = unseen.astype(np.float32), max(2, round(k * len(unseen) / rows))
            foreign = asked and len(test) >= 20 and len(asked[1]) >= 60
            test = test if foreign else y
            at = nearest(test, y, few, True, (asked[1][2::3], asked[0][learned:]) if foreign else None)
            to = self.parts_of(y)[at]
        rank = np.argsort(np.argsort(-self.route.logits(test), 1, kind="stable"), 1, kind="stable")
        at = rank[np.arange(len(rank))[:, None], to]
        found = np.cumsum(np.bincount(at.ravel(), minlength=self.parts)) / at.size
        if asked:  # of a part, which may have few: less what chance may have added
            found -= np.array([(at < i + 1).mean(1).std() for i in range(self.parts)]) / math.sqrt(len(at))
            found[-1] = 1
        self.probes = int(np.searchsorted(found, recall)) + 1

    def shares(self, part: np.ndarray) -> np.ndarray:
        """Which share of a row's entries each part has."""
        at = np.arange(len(part))[:, None] * self.parts + part
        return (np.bincount(at.ravel(), minlength=len(part) * self.parts).reshape(len(part), self.parts) / part.shape[1]).astype(np.float32)

    def parts_of(self, x: np.ndarray) -> np.ndarray:
        return self.place.logits(x).argmax(1) if self.parts > 1 else np.zeros(len(x), np.int64)

    def opened(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.route.logits(x), 1, kind="stable")[:, : self.probes]


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among x: query ids, ids, scores."""
    out = []
    many = max(1, SCORES // max(1, len(x)))
    for a in range(0, len(q), many):
        s = q[a : a + many] @ x.T
        s[qid[a : a + many][:, None] == vid[None, :]] = -np.inf
        least = np.partition(s, max(0, s.shape[1] - k), 1)[:, max(0, s.shape[1] - k)]
        i, j = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (s > -np.inf))  # all that may tie
        exact = dots(q[a + i], x[j])
        order = np.lexsort((vid[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        head = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        nth = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i))))
        keep = nth < k
        out.append((qid[a + i[keep]], vid[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def some(rows: DataFrame, many: int) -> DataFrame:
    """About `many` rows of each part, by a hash of the id. rows: id, part, n (rows of the part)."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.ceil(F.lit(float(many << 30)) / F.col("n")))


def divided(placed: DataFrame, asked: DataFrame, k: int, recall: float, leaf: int, sample: int) -> tuple[DataFrame, DataFrame] | None:
    """placed and asked (id, x, part), with parts of more than `leaf` rows replaced by their own parts; None if there are none."""
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
    large = materialise(counts.join(asked.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part"), "large")  # parts that nobody opens stay as they are
    if large.isEmpty():
        return None
    inner, outer = placed.join(large, "part"), asked.join(large, "part")

    def learn(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"part": [], "model": []})
        own = own.iloc[np.argsort([xxhash.xxh3_64_intdigest(str(i)) for i in own["id"]])[: sample + sample // 2]]
        asks = (own["id"].to_numpy(), queries["id"].to_numpy(), stacked(queries["x"]) if len(queries) else np.zeros((0, 1)))
        index = Index(stacked(own["x"]), int(own["n"].iloc[0]), k, recall, asks, sample)
        return pd.DataFrame({"part": [own["part"].iloc[0]], "model": [pickle.dumps(index)]})

    columns = ("part", "id", "x", "n")
    met = some(inner, sample + sample // 2).select(*columns).groupBy("part").cogroup(some(outer.withColumn("n", F.col("m")), sample // 3).select(*columns).groupBy("part"))
    models = materialise(met.applyInPandas(learn, "part long, model binary"), "models")

    def dealt(rows: DataFrame, count: str, size: int, where) -> DataFrame:
        """Rows of a part in cells, each of which gets the part's model."""
        cells = F.ceil(F.col(count) / size).cast("int")
        rows = rows.select("part", F.pmod(F.xxhash64("id"), cells).cast("int").alias("cell"), "id", "x")
        each = models.join(large, "part").select("part", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), "model")
        x = rows.schema["x"].dataType.simpleString()

        def below(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"id": [], "x": [], "part": []})
            to = where(pickle.loads(model["model"].iloc[0]), stacked(rows["x"]))
            row, at = np.repeat(np.arange(len(to)), to.shape[1]), to.ravel()
            return pd.DataFrame({"id": rows["id"].to_numpy()[row], "x": rows["x"].to_numpy()[row], "part": (rows["part"].iloc[0] + 1) * WIDE + at})

        return rows.groupBy("part", "cell").cogroup(each.groupBy("part", "cell")).applyInPandas(below, f"id long, x {x}, part long")

    now = [dealt(inner, "n", VECTORS, lambda index, x: index.parts_of(x)[:, None]), dealt(outer, "m", QUERIES, lambda index, x: index.opened(x))]
    return tuple(materialise(old.join(large, "part", "left_anti").select("id", "x", "part").unionByName(new), name) for old, new, name in zip((placed, asked), now, ("placed", "asked"), strict=True))


def search(df: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", index: Index | None = None, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest found among all rows."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("x"))
    if df.schema[vector].dataType.simpleString() != "array<float>":  # floats are carried as such, and are doubles where they are worked with
        rows = rows.withColumn("x", F.col("x").cast("array<double>"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x")))
    dim = (rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect() or [(0,)])[0][0]
    rows = rows.where(F.size("x") == dim)
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if ids < n:
        n, rows = ids, materialise(rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x"))["x"].alias("x")), "one-of-each-id")
    widest = sample // LEARN_PART
    levels = 1 + sum(n > leaf * widest**level for level in range(1, DEEP + 1))
    recall = RECALL ** (1 / levels)
    if index is None:
        # the share of hashes that gives about as many rows as wanted: no task sends more than its own share
        drawing = sample + sample // 2
        share = min(1 << 30, math.ceil((1 << 30) * drawing / max(n, 1)))
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).limit(2 * drawing).collect()
        drawn = sorted(drawn, key=lambda r: xxhash.xxh3_64_intdigest(str(r.id)))[:drawing]
        index = Index(np.array([r.x for r in drawn], float).reshape(len(drawn), dim), n, k, recall, learned=sample)
    shared = df.sparkSession.sparkContext.broadcast(index)  # of one size, whatever the input

    @F.pandas_udf("long")
    def part(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.parts_of(stacked(x))).astype("int64")

    @F.pandas_udf("array<long>")
    def routes(x: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.opened(stacked(x)).astype(np.int64)))

    placed = materialise(rows.withColumn("part", part("x")), "placed")
    asked = materialise(rows.where(F.col("id") % every == 0).withColumn("part", F.explode(routes("x"))), "asked")
    deep = 0
    while deep < DEEP and (below := divided(placed, asked, k, recall if deep + 1 < levels else SURE, leaf, sample)):
        (placed, asked), deep = below, deep + 1
    need = lambda t, name, size: t.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    split = need(placed, "n", VECTORS).join(need(asked, "m", QUERIES), "part")  # a row for each part, of which there are more the larger the table
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = placed.join(split, "part").select("part", deal("n").alias("i"), every_("m").alias("j"), "id", "x")
    queries = asked.join(split, "part").select("part", every_("n").alias("i"), deal("m").alias("j"), "id", "x")

    def cell(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """A row for each query, with its k nearest in the cell."""
        if not len(own) or not len(queries):
            return pd.DataFrame({"query_id": [], "some": [], "near": []})
        a, b, c = best(queries["id"].to_numpy(), stacked(queries["x"]), own["id"].to_numpy(), stacked(own["x"]), k)
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
        ends = np.append(head[1:], len(a))[: len(head)]
        near = [[{"less": -s, "vec_id": v} for s, v in zip(c[i:j].tolist(), b[i:j].tolist(), strict=True)] for i, j in zip(head, ends, strict=True)]
        return pd.DataFrame({"query_id": a[head], "some": int(own["part"].iloc[0]) % 64, "near": near})

    keys = ("part", "i", "j")
    found = own.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(cell, "query_id long, some int, near array<struct<less: double, vec_id: long>>")
    # k entries of each cell that a query opened, first of a few cells together
    first = lambda t, *by: t.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    if deep:
        found = first(found, "query_id", "some")
    top = first(found, "query_id")
    return top.select("query_id", F.posexplode("near").alias("place", "n")).select("query_id", (F.col("place") + 1).alias("rank"), "n.vec_id", (-F.col("n.less")).alias("score"))
