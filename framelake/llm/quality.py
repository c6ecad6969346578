"""Quality of documents: ridge regression on random Fourier features of document statistics, calibrated isotonically.

1. Statistics of each whole text (shares of kinds of characters, words and lines, repeats, function words, lengths): one
   pass over the texts, whose result is written. Nothing after that reads a text again.
2. Labelled rows are standardised; FEATURES cosines of random projections approximate a Gaussian kernel of WIDTH. Each task
   sums its rows' normal equations by fold; Spark adds the sums up; the driver solves systems of one fixed size.
   The ridge is that of RIDGES with the least squared error on folds left out, which the sums of folds tell by themselves.
3. Each labelled row is scored by the fit without its own fold. Counts of these scores and of ones among them, in BINS bins,
   are pooled until they ascend (isotonic regression), and probabilities lie on the line between the pools' middles.

All labelled rows that aren't held out are learned from (of rows that repeat a key one); there is no sample.

Defined cases: a null or empty text, or one without words, has statistics of nought; texts are taken whole, a very long one
in a block of its own; rows that repeat are scored alike; a null label teaches nothing; of several labels of a key the
largest counts; a null key teaches nothing and is scored; with labels of one class, or none, every score is that class's
share (0.5 without any); an empty table gives an empty result; other columns come along in `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .scratch import materialise
from .toxicity import FUNCTION_WORDS, held_out

#: Random features, the kernel's width (in standard deviations, times the root of the number of statistics), and what may be added to the diagonal for each row.
FEATURES, WIDTH = 256, 0.7
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
FOLDS = 5
#: Bins of scores between LOW and HIGH that calibration counts.
BINS, LOW, HIGH = 2048, -0.5, 1.5
CUT = 0.5
#: Standardised statistics go no farther than this.
FAR = 6.0
BLOCK = 1 << 20

NAMES = (
    "log_bytes", "log_words", "letters", "capitals", "digits", "white", "stops", "signs", "breaks",
    "word_length", "word_spread", "capital_words", "signed_words", "bare_words", "twins", "distinct", "top_word",
    "function_words", "line_words", "closed_lines", "same_lines",
)
UPPER, LOWER, DIGIT, STOP = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
STOP[[ord(c) for c in ".,;:?!'\"()-"]] = True
LETTER = UPPER | LOWER
LETTER[128:] = True
SIGN = ~(LETTER | DIGIT | STOP | B.WHITE)
KNOWN = sorted({w for words in FUNCTION_WORDS.values() for w in words.split()})


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    return part / np.maximum(of, 1)


def repeated(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's items: how many are different, and how often the most frequent one occurs."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    pair, times = np.unique(owner * (int(code.max(initial=0)) + 1) + code, return_counts=True)
    owner = pair // (int(code.max(initial=0)) + 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, times)
    return np.bincount(owner, minlength=n), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text, in the order of NAMES."""
    n = np.diff(offsets).astype(float)
    kinds = [sums(kind[data], offsets) for kind in (LETTER, UPPER, DIGIT, B.WHITE, STOP, SIGN)]
    letters, capitals, digits, white, stops, signs = kinds
    latin = sums((UPPER | LOWER)[data], offsets)
    breaks = sums(data == 10, offsets)
    starts, ends, packed, first = B.words(data, offsets)
    words, length = np.diff(first).astype(float), ends - starts
    mean = share(sums(length, first), words)
    spread = np.sqrt(np.maximum(share(sums(length.astype(float) ** 2, first), words) - mean**2, 0))
    code, distinct = B.codes(B.LOWER[packed], length)
    at = np.concatenate([[0], np.cumsum(length)])
    has_letter = np.diff(np.concatenate([[0], np.cumsum(LETTER[packed])])[at]) > 0
    shout = (np.diff(np.concatenate([[0], np.cumsum(UPPER[packed])])[at]) > 1) & (np.diff(np.concatenate([[0], np.cumsum(LOWER[packed])])[at]) == 0)
    odd = SIGN | (np.arange(256) == ord("!"))
    signed = odd[data[ends - 1]] & has_letter if len(ends) else has_letter
    twin = np.zeros(len(code), bool)
    twin[1:] = code[1:] == code[:-1]
    twin[first[:-1][first[:-1] < len(code)]] = False
    different, top = repeated(code, first)
    bare = distinct.cast(pa.large_binary()).to_pylist()
    known = set(KNOWN)
    function = np.array([w.rstrip(b".,;:!?").decode("utf-8", "replace") in known for w in bare], bool)[code] if len(code) else np.zeros(0, bool)
    # lines: what stands between line feeds and isn't empty
    cut = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    line_first = np.searchsorted(cut, offsets)
    last = data[np.maximum(cut[1:] - 2, cut[:-1])] if len(cut) > 1 else np.zeros(0, np.uint8)
    ends_text = np.isin(cut[1:], offsets)
    last = np.where(ends_text & (data[np.maximum(cut[1:] - 1, 0)] != 10), data[np.maximum(cut[1:] - 1, 0)], last) if len(cut) > 1 else last
    lines = np.diff(line_first).astype(float)
    closed = sums((last == ord(".")) | (last == ord("?")), line_first)
    line_code, _ = B.codes(data, np.diff(cut))
    line_kinds, _ = repeated(line_code, line_first)
    columns = [
        np.log1p(n), np.log1p(words), share(letters, n), share(capitals, latin), share(digits, n), share(white, n), share(stops, n), share(signs, n), share(breaks, n),
        mean, spread, share(sums(shout, first), words), share(sums(signed, first), words), share(sums(~has_letter, first), words), share(sums(twin, first), words), share(different, words), share(top, words),
        share(sums(function, first), words), np.log1p(share(words, lines)), share(closed, lines), share(lines - line_kinds, lines),
    ]
    return np.stack(columns, 1)


def statistics(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row: row (a struct of its columns, or of those to carry) and x (the statistics of its whole text), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches, "text", BLOCK):
            x = features(*B.buffers(block.column("text"))).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([block.column("row"), lists], ["row", "x"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)]).alias("row"), F.col(f"`{text}`").alias("text"))
    return materialise(rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("x", T.ArrayType(T.FloatType()))])), "statistics")


class Model:
    """mean, scale: of the statistics; turn, phase: the random projections; w: the ridge's weights; knots: scores and their probabilities."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = rng.standard_normal((len(mean), features)) / (WIDTH * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.w = np.zeros(features + 1)
        self.knots = (np.zeros(1), np.full(1, 0.5))

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random features and a one."""
        z = np.clip((x - self.mean) / self.scale, -FAR, FAR)
        return np.concatenate([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.expand(x) @ self.w, *self.knots)


def solved(total: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by a matrix of sums of products of (features, one, label); the one isn't penalised."""
    a, b = total[:-1, :-1].copy(), total[:-1, -1]
    a[np.arange(len(a) - 1), np.arange(len(a) - 1)] += ridge * max(1.0, total[-2, -2])
    return np.linalg.lstsq(a, b, rcond=None)[0]


def left_out_error(fold: np.ndarray, w: np.ndarray) -> float:
    """Sum of squares over a fold of label - w . features, by its sums of products."""
    v = np.append(-w, 1.0)
    return float(v @ fold @ v)


def pooled(n: np.ndarray, ones: np.ndarray) -> list[tuple[int, int, float]]:
    """Isotonic regression: runs (first, last, share of ones) of neighbouring bins whose shares ascend, by pooling neighbours that don't."""
    out: list[list[float]] = []
    for i in np.flatnonzero(n):
        out.append([i, i, float(n[i]), float(ones[i])])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, last, m, k = out.pop()
            out[-1][1] = last
            out[-1][2] += m
            out[-1][3] += k
    return [(int(a), int(z), k / m) for a, z, m, k in out]


def knots(n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    runs = pooled(n, ones)
    middle = LOW + (np.array([(a + z + 1) / 2 for a, z, _ in runs])) * (HIGH - LOW) / BINS
    return middle, np.array([p for _, _, p in runs])


def normal_equations(table: DataFrame, model: Model) -> np.ndarray:
    """fold x row x column: sums over all rows (x, y, fold) of products of (features, one, label). Tasks send their sums, a row of a matrix each."""
    size = len(model.w) + 1
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, m = np.zeros((FOLDS, size, size)), shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, y, fold = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1), part.column("y").to_numpy(), part.column("fold").to_numpy()
                z = np.concatenate([m.expand(x), y[:, None]], 1)
                for f in np.unique(fold):
                    own = z[fold == f]
                    total[f] += own.T @ own
        at = np.flatnonzero(total.any(2).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(total.reshape(-1, size)[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), lists], ["at", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        """Of one row of a matrix, a row a task; in an order that doesn't depend on which task was first."""
        x = rows["sums"].combine_chunks().flatten().to_numpy().reshape(len(rows), size)
        return pa.table({"at": rows["at"].slice(0, 1), "sums": [np.sort(x, 0).sum(0)]})

    found = table.mapInArrow(run, "at long, sums array<double>").groupBy("at").applyInArrow(add, "at long, sums array<double>").collect()  # of one size
    out = np.zeros((FOLDS * size, size))
    for r in found:
        out[r["at"]] = r.sums
    return out.reshape(FOLDS, size, size)


def calibration(table: DataFrame, model: Model, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bin of score: rows, and ones among them; each row by the weights of its fold."""
    shared = table.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = shared.value
        n, ones = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                z = m.expand(part.column("x").flatten().to_numpy().reshape(part.num_rows, -1))
                s = (z * w[part.column("fold").to_numpy()]).sum(1)
                at = np.clip(((s - LOW) * BINS / (HIGH - LOW)).astype(np.int64), 0, BINS - 1)
                n += np.bincount(at, minlength=BINS)
                ones += np.bincount(at[part.column("y").to_numpy() == 1], minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(ones[at])], ["bin", "n", "ones"])

    n, ones = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for r in table.mapInArrow(run, "bin long, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():  # bins
        n[r.bin], ones[r.bin] = r.n, r.ones
    return n, ones


def fit(found: DataFrame, key: Column, labels: DataFrame, label_key: str = "doc_id", label: str = "quality") -> Model:
    """Learns from all labelled rows of found (from statistics) that aren't held out. key: of found's rows."""
    known = labels.where(F.col(f"`{label}`").isNotNull() & ~held_out(F.col(f"`{label_key}`"))).groupBy(F.col(f"`{label_key}`").cast("long").alias("k")).agg((F.max(f"`{label}`") > 0).cast("double").alias("y"))
    rows = found.select(key.cast("long").alias("k"), "x").where("k is not null").groupBy("k").agg(F.min("x").alias("x"))  # map-side too: a key that very many rows share is no hot key
    table = rows.join(known.where("k is not null"), "k").select("x", "y", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold"))  # equal texts are of one fold
    table = materialise(table, "labelled")
    moments = table.select("y", F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.sum(F.col("v") * F.col("v")).alias("s")).orderBy("at").collect()  # a row a statistic
    if not moments:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(np.array([r.mean for r in moments]), np.array([r.scale if r.scale > 1e-9 else 1.0 for r in moments]))
    n, ones = moments[0].n, moments[0].ones
    if not 0 < ones < n:
        model.knots = (np.zeros(1), np.full(1, ones / n))
        return model
    folds = normal_equations(table, model)
    total = folds.sum(0)
    # a fold that has no rows leaves nothing out
    errors = [sum(left_out_error(f, solved(total - f, ridge)) for f in folds) for ridge in RIDGES]
    ridge = RIDGES[int(np.argmin(errors))]
    model.knots = knots(*calibration(table, model, np.stack([solved(total - f, ridge) for f in folds])))
    model.w = solved(total, ridge)
    return model


def score(found: DataFrame, model: Model) -> DataFrame:
    """row, score (0 to 1: the probability of label 1) of statistics."""
    shared = found.sparkSession.sparkContext.broadcast(model)  # of one size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(shared.value.probabilities(x))], ["row", "score"])

    return found.select("row", "x").mapInArrow(run, T.StructType([found.schema["row"], T.StructField("score", T.DoubleType())]))
