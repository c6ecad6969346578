"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word (a run of letters, A-Z lower-cased) is the sum of the embeddings of its hash and of the hashes of its first 4, 5
and 6 bytes, so forms of one stem are near each other. Filters of 1, 2 and 3 words run over the whole text, each
keeps its greatest response, and a logistic layer makes these a probability. Embeddings start from the log odds of their
rows in the training texts. All labelled rows that aren't held out are learned from: log odds are sums over all tasks; steps
of stochastic gradients are taken in numpy by up to LEARNERS tasks, each over the rows of its own part, a block after the
other, and the mean of their models (8 MB each) counts. A fifth of the rows is held back; from the counts of all their scores
in BINS bins, a threshold is chosen for each language and the score rescaled so that the threshold lies at CUT. The language
is guessed from the text's own function words.

Defined cases: a null or empty text, or one without letters, is scored by the filters' response to padding; texts are
scored whole; rows that repeat are scored alike; with labels of one class only, every score is that class's share; a
null key counts as the empty string where keys deal out rows to training; an empty table gives an empty result; other
columns aren't read (score) or come along unchanged (clean).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import bpe
from .scratch import materialise

#: Half the labelled rows that a learner gets, unless there are more than LEARNERS times as many; bytes of their texts that it works on at once.
SAMPLE, LEARNERS, LEARN_BYTES = 4000, 16, 16 << 20
#: Bins of scores from which thresholds are chosen: of equal width in log odds, from -Z_MOST to Z_MOST.
BINS, Z_MOST = 8000, 20.0
#: Rows of the embedding, its width, filters of each width.
ROWS, WIDTH, FILTERS, SPANS = 1 << 18, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 32, 0.1
CUT = 0.7
PAD = max(SPANS)
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as are be this by from at or an not which you",
    "fr": "le la les des du et un une est que qui dans pour pas sur au avec ce il elle sont par plus",
    "de": "der die das und ist nicht ein eine den dem zu mit auf von sich im auch es an werden oder bei",
    "es": "el los las del y en un una es que por con para se no su al lo como más pero sus este",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


class Words:
    """Words of some texts: codes with PAD zeros' codes after each document, hashed rows of each distinct word, a language for each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = B.LOWER[data]
        solid = bpe.kinds(data) == bpe.LETTER
        edge = np.zeros(len(data) + 1, np.int8)
        edge[1:] = solid
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(solid & ((edge[:-1] == 0) | begins[:-1]))
        ends_mask = solid & np.append(~solid[1:] | begins[1:-1], True) if len(data) else solid
        ends = np.flatnonzero(ends_mask) + 1
        code, distinct = B.codes(data[solid], ends - starts)
        first = np.searchsorted(starts, offsets)
        n = np.diff(first)
        words = distinct.to_pylist()
        h = xxhash.xxh3_64_intdigest
        rows = np.array([[h(w), h(w[:4], 1), h(w[:5], 2), h(w[:6], 3)] for w in words], np.uint64).reshape(-1, 4)
        self.rows = np.concatenate([(rows % np.uint64(ROWS - 1)).astype(np.int32), np.full((1, 4), ROWS - 1, np.int32)])  # the last word is padding
        pad = len(words)
        self.at = np.concatenate([[0], np.cumsum(n + PAD)])
        self.code = np.full(int(self.at[-1]), pad, np.int32)
        where = B.ragged(self.at[:-1], n)
        self.code[where] = code
        self.n = np.maximum(n, 1)
        self.language = self._guess(words, where, code, n)

    def take(self, docs: np.ndarray) -> "Words":
        """The words of some of the texts."""
        out, size = object.__new__(Words), np.diff(self.at)[docs]
        out.at, out.n, out.language = np.concatenate([[0], np.cumsum(size)]), self.n[docs], self.language[docs]
        seen, out.code = np.unique(self.code[B.ragged(self.at[docs], size)], return_inverse=True)
        out.rows = self.rows[seen]
        return out

    def _guess(self, words: list[bytes], where: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(n)), n)
        seen = []
        for known in FUNCTION_WORDS.values():
            known = {w.encode() for w in known.split()}
            hit = np.fromiter((w in known for w in words), bool, len(words))
            seen.append(np.bincount(doc[hit[code]], minlength=len(n)) if len(words) else np.zeros(len(n), np.int64))
        seen = np.array(seen)
        return np.where(seen.max(0) > 0, seen.argmax(0), len(LANGUAGES) - 1)


def joined(pieces: list[Words]) -> Words:
    """Words of all texts of several pieces; a word of two pieces has a code in each."""
    out = object.__new__(Words)
    base = np.cumsum([0] + [len(w.rows) for w in pieces])
    out.code = np.concatenate([w.code + k for w, k in zip(pieces, base[:-1].astype(np.int32), strict=True)])
    out.at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.at) for w in pieces]))])
    out.rows, out.n, out.language = (np.concatenate([getattr(w, c) for w in pieces]) for c in ("rows", "n", "language"))
    return out


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    model = {"E": (rng.standard_normal((ROWS, WIDTH)) * 0.01).astype(np.float32), "b": np.zeros(len(SPANS) * FILTERS, np.float32)}
    model["E"][-1] = 0
    for s in SPANS:
        model[f"W{s}"] = (rng.standard_normal((s, WIDTH, FILTERS)) * 0.2).astype(np.float32)
        model[f"W{s}"][0, 0, : FILTERS // 2] = 1
    model["v"] = np.full(len(SPANS) * FILTERS, 0.05, np.float32)
    model["c"] = np.zeros(1, np.float32)
    return model


def responses(model: dict[str, np.ndarray], words: Words, track: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each document's greatest response of each filter, and where it was."""
    emb = model["E"][words.rows].sum(1)
    docs, out, where = len(words.n), [], []
    span = B.ragged(words.at[:-1], words.n)
    head = np.concatenate([[0], np.cumsum(words.n)[:-1]])
    for s in SPANS:
        total = None
        for j in range(s):
            part = (emb @ model[f"W{s}"][j])[words.code[span + j]]
            total = part if total is None else total + part
        best = np.maximum.reduceat(total, head, axis=0) if docs else np.zeros((0, FILTERS), np.float32)
        out.append(best)
        if track:
            doc = np.repeat(np.arange(docs), words.n)
            at = np.zeros((docs, FILTERS), np.int64)
            i, f = np.nonzero(total == best[doc])
            at[doc[i][::-1], f[::-1]] = span[i][::-1]  # the first place counts
            where.append(at)
    z = np.concatenate(out, 1) + model["b"]
    return np.maximum(z, 0), np.concatenate(where, 1) if track else None


def probabilities(model: dict[str, np.ndarray], words: Words) -> np.ndarray:
    z, _ = responses(model, words)
    return 1 / (1 + np.exp(-(z.astype(np.float64) @ model["v"].astype(np.float64) + float(model["c"][0]))))


def constant(share: float) -> dict[str, np.ndarray]:
    """The model of labels of one class, or of none: every score is the share of toxic ones."""
    model, share = fresh(np.random.default_rng(7)), np.clip(share, 1e-6, 1 - 1e-6)
    return model | {"v": model["v"] * 0, "c": np.array([np.log(share / (1 - share))], np.float32), "theta": np.full(len(LANGUAGES), CUT)}


def seen(words: Words, truth: np.ndarray) -> np.ndarray:
    """Texts of each class (2 x ROWS) that hold each row."""
    doc = np.repeat(np.arange(len(truth)), np.diff(words.at))
    pairs = np.unique((doc[:, None] * ROWS + words.rows[words.code]).ravel())
    return np.bincount(truth[pairs // ROWS].astype(np.int64) * ROWS + pairs % ROWS, minlength=2 * ROWS).reshape(2, ROWS)


def start(counts: np.ndarray, neg: int, pos: int) -> dict[str, np.ndarray]:
    """A model before any step, from the log odds of each row by all documents."""
    model = fresh(np.random.default_rng(7))
    # a few documents' worth of doubt, so that rare rows stay near nothing
    prior = 2.0
    odds = np.log((counts[1] + prior * pos / (pos + neg)) / (pos + prior)) - np.log((counts[0] + prior * neg / (pos + neg)) / (neg + prior))
    model["E"][:, 0] += np.clip(odds - np.log((pos / (pos + neg)) / (pos + prior) * (neg + prior) / (neg / (pos + neg))), -4, 4).astype(np.float32) / 4
    model["E"][-1] = 0
    model["v"][:] = 0.5
    model["c"][0] = -4
    return model


def history(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.full(x.shape if k != "E" else (ROWS, 1), 1e-2, np.float32) for k, x in model.items()}


def learn(model: dict[str, np.ndarray], squares: dict[str, np.ndarray], words: Words, truth: np.ndarray, rng: np.random.Generator) -> None:
    """EPOCHS passes over some texts."""
    place = np.arange(len(truth))
    for _ in range(EPOCHS):
        rng.shuffle(place)
        for a in range(0, len(place), BATCH):
            part = place[a : a + BATCH]
            step(model, squares, words.take(part), truth[part])


def parsed(col: pa.Array) -> Iterator[tuple[int, Words]]:
    """Words of 256 texts at a time, with the place of the first."""
    for a in range(0, len(col), 256):
        yield a, Words(*B.buffers(col.slice(a, 256)))


def train(texts: list[str], truth: np.ndarray, keep_back: np.ndarray) -> dict[str, np.ndarray]:
    """A model of texts at hand, with a threshold for each language. keep_back: rows that only choose thresholds."""
    fit_, use = np.flatnonzero(~keep_back), np.flatnonzero(keep_back if keep_back.any() else ~keep_back)
    y = truth[fit_]
    if len(np.unique(y)) < 2:
        return constant(truth.mean() if len(truth) else 0.0)
    col = pa.array(texts, pa.large_string())
    pieces = list(parsed(col.take(pa.array(fit_))))
    model = start(sum(seen(w, y[a : a + 256]) for a, w in pieces), int((y == 0).sum()), int((y == 1).sum()))
    learn(model, history(model), joined([w for _, w in pieces]), y, np.random.default_rng(8))
    model["theta"] = thresholds(sum(tallied(model, w, truth[use][a : a + 256]) for a, w in parsed(col.take(pa.array(use)))))
    return model


def step(model: dict[str, np.ndarray], squares: dict[str, np.ndarray], words: Words, truth: np.ndarray) -> None:
    """One gradient step (each parameter by its own history of gradients)."""
    z, at = responses(model, words, True)
    p = 1 / (1 + np.exp(-(z @ model["v"] + model["c"][0])))
    g = ((p - truth) / len(truth)).astype(np.float32)
    grads = {"c": g.sum(keepdims=True), "v": z.T @ g}
    dz = g[:, None] * model["v"][None, :] * (z > 0)
    grads["b"] = dz.sum(0)
    rows, values = [], []
    for k, s in enumerate(SPANS):
        d, where = dz[:, k * FILTERS : (k + 1) * FILTERS], at[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.zeros_like(model[f"W{s}"])
        for j in range(s):
            r = words.rows[words.code[where + j]]  # documents x filters x 4
            emb = model["E"][r].sum(2)
            grad[j] = np.einsum("df,dfw->wf", d, emb)
            value = d[:, :, None] * model[f"W{s}"][j].T[None]
            rows.append(np.repeat(r.reshape(-1, 4), 1, 0).ravel())
            values.append(np.repeat(value.reshape(-1, WIDTH), 4, 0))
        grads[f"W{s}"] = grad
    for name, grad in grads.items():
        squares[name] += grad * grad
        model[name] -= RATE * 0.3 * grad / np.sqrt(squares[name])
    row, which = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.zeros((len(row), WIDTH), np.float32)
    np.add.at(total, which, np.concatenate(values))
    total[row == ROWS - 1] = 0
    squares["E"][row] += (total * total).mean(1, keepdims=True)
    model["E"][row] -= RATE * total / np.sqrt(squares["E"][row])


def tallied(model: dict[str, np.ndarray], words: Words, truth: np.ndarray) -> np.ndarray:
    """Texts by language, bin of their score and class."""
    with np.errstate(divide="ignore"):
        p = probabilities(model, words)
        z = np.clip(np.log(p) - np.log1p(-p), -Z_MOST, Z_MOST)
    at = (words.language * BINS + np.minimum(((z + Z_MOST) * (BINS / (2 * Z_MOST))).astype(np.int64), BINS - 1)) * 2 + truth.astype(np.int64)
    return np.bincount(at, minlength=len(LANGUAGES) * BINS * 2).reshape(len(LANGUAGES), BINS, 2)


def thresholds(counts: np.ndarray) -> np.ndarray:
    """For each language the cut between bins with the best F1 (in the middle of the empty ones that give it); that of all rows where a class has under 5."""
    edges = 1 / (1 + np.exp(-(np.arange(BINS + 1) * (2 * Z_MOST / BINS) - Z_MOST)))

    def best(tally: np.ndarray) -> float | None:
        if (tally.sum(0) < 5).any():
            return None
        bins = np.flatnonzero(tally.sum(1))[::-1]  # from the top
        hits, found = np.cumsum(tally[bins, 1]), np.cumsum(tally[bins].sum(1))
        f1 = 2 * hits / (found + hits[-1])
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)[-1]
        below = edges[bins[top + 1] + 1] if top + 1 < len(bins) else 0.0
        return float(np.clip((edges[bins[top]] + below) / 2, 0.02, 0.98))

    common = best(counts.sum(0)) or 0.5
    return np.array([best(c) or common for c in counts])


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def training_rows(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """k, t, y, part, back: all labelled keys with their whole texts; of rows that repeat a key the one with the least hash of its text; never held-out ones.

    part: the learner that a row goes to (of about 2 * sample rows each, LEARNERS at most); back: rows, a fifth, that only choose thresholds.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("k")).agg(F.max(label).cast("int").alias("y")).where("k is not null")
    texts = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(known, "k")
    one = texts.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))  # of rows that repeat a key one
    one = materialise(one, "labelled")
    parts = min(LEARNERS, max(1, -(-one.count() // (2 * sample))))
    h = F.xxhash64("k")
    return one.select("k", "t", "y", F.pmod(F.shiftright(h, 8), F.lit(parts)).cast("int").alias("part"), (F.pmod(h, F.lit(5)) == 4).alias("back"))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Trains on all training_rows: log odds by all tasks, steps by learners whose models are averaged, thresholds by all tasks."""
    rows, sc = training_rows(df, labels, key, text, label, sample), df.sparkSession.sparkContext
    n = {(r.back, r.y): r.n for r in rows.groupBy("back", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    neg, pos = n.get((False, 0), 0), n.get((False, 1), 0)
    if not neg or not pos:
        return constant((pos + n.get((True, 1), 0)) / max(1, sum(n.values())))

    def summed(rows: DataFrame, each: Callable[[Words, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of what each gives for some texts, an array of a fixed size."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for block in B.blocks(batches, "t", B.BLOCK_BYTES // 2):
                for a, w in parsed(block.column("t")):
                    total += each(w, block.column("y").slice(a, 256).to_numpy()).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

        found = rows.select("t", "y").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[found["at"].to_numpy()] = found["n"].to_numpy()
        return out

    first = sc.broadcast(start(summed(rows.where("not back"), seen, 2 * ROWS).reshape(2, ROWS), neg, pos))  # of one size, whatever the input

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One part's rows, LEARN_BYTES of text at a time."""
        model, rng, part, count = {k: x.copy() for k, x in first.value.items()}, np.random.default_rng(8), None, 0
        squares = history(model)
        for block in B.gathered(batches, "t", LEARN_BYTES):
            part, count = block.column("part")[0].as_py(), count + block.num_rows
            learn(model, squares, joined([w for _, w in parsed(block.column("t"))]), block.column("y").to_numpy().astype(np.float32), rng)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([pickle.dumps(model)], pa.binary())], ["part", "rows", "model"])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for b in batches:
            for k in range(b.num_rows):
                own, n = pickle.loads(b.column("model")[k].as_py()), b.column("rows")[k].as_py()  # noqa: S301  our own bytes
                total, count = {x: v.astype(np.float64) * n + (total[x] if total else 0) for x, v in own.items()}, count + n
        if count:
            mean = {x: (v / count).astype(np.float32) for x, v in total.items()}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mean)], pa.binary())], ["model"])

    parts = rows.where("not back").repartitionById(LEARNERS, "part").sortWithinPartitions("part", F.xxhash64("k"), "k")
    models = parts.select("t", "y", "part").mapInArrow(learner, "part int, rows long, model binary")
    # LEARNERS models at most, one at a time
    model = pickle.loads(models.repartition(1).sortWithinPartitions("part").mapInArrow(averaged, "model binary").first().model)  # noqa: S301  our own bytes
    first.destroy()
    done = sc.broadcast(model)
    counts = summed(rows.where("back") if any(back for back, _ in n) else rows, lambda w, y: tallied(done.value, w, y), len(LANGUAGES) * BINS * 2)
    done.destroy()
    model["theta"] = thresholds(counts.reshape(len(LANGUAGES), BINS, 2))
    return model


def rescaled(p: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """p, with theta moved to CUT."""
    return np.clip(np.where(p < theta, CUT * p / theta, CUT + (1 - CUT) * (p - theta) / (1 - theta)), 0, 1)


def score(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row's columns to carry (all, if not said) with score (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of one size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in B.blocks(batches, "text", B.BLOCK_BYTES // 2):
            w = Words(*B.buffers(block.column("text")))
            s = rescaled(probabilities(m, w), m["theta"][w.language])
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(s, pa.float64())], ["row", "score"])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)]).alias("row"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
