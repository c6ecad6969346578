"""Rows that share a key, or have none, are judged by their own texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framelake.llm import blocks as B
from framelake.llm import substrings


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def kept_rows(rows, size):
    """The loop of the definition: of equal windows those stay that none with a smaller (key, start) equals; rows in their order."""
    order = lambda k: -(1 << 63) if k is None else k
    first: dict[tuple, tuple] = {}
    windows = lambda t: [(i, tuple(t[i : i + size])) for i in range(len(t) - size + 1)]
    texts = [(key, (text or "").split()) for key, text in rows]
    for key, t in texts:
        for i, w in windows(t):
            first[w] = min(first.get(w, (order(key), i)), (order(key), i))
    out = []
    for key, t in texts:
        gone = {k for i, w in windows(t) if first[w] < (order(key), i) for k in range(i, i + size)}
        out.append((key, len(t), len(gone), " ".join(x for k, x in enumerate(t) if k not in gone)))
    return sorted(out, key=str)


def test_hashes_are_spark_s(spark, rows):
    texts = [r[1] or "" for r in rows] + ["ab" * k + "é" for k in range(40)]
    want = [r.h for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").orderBy("k").select(F.xxhash64("t").alias("h")).collect()]
    assert substrings.digests(*B.buffers(pa.array(texts))).tolist() == want
    assert substrings.digests(np.zeros(0, np.uint8), np.zeros(1, np.int64)).tolist() == []


def test_each_row_loses_its_own_words(spark):
    p, q = words("p", 25), words("q", 30)
    rows = [
        (None, p), (None, words("a", 40) + " " + p), (None, words("b", 3)), (None, words("c", 70)), (None, None), (None, p),
        (5, q), (7, words("d", 6) + " " + q + " " + words("e", 2)), (7, words("f", 60)), (7, words("g", 2)), (7, q),
        (9, p + " " + words("h", 30) + " " + q), (9, words("i", 4)), (9, p),
    ]
    want = kept_rows(rows, 20)
    assert sum(w[2] for w in want) and all(w[2] == 0 for w in want if w[3][:2] in ("b0", "c0", "f0", "g0", "i0"))
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, 20).collect()), key=str)
        assert got == want


def test_copies_of_a_row_keep_one_list_of_spans(spark):
    """An earlier document and 400 rows of one doc_id and text: each row's spans are its own, not those of all copies."""
    p = words("p", 30)
    df = spark.createDataFrame([(1, p), *[(2, "x " + p)] * 400], "doc_id long, text string").repartition(7)
    spans = [r.spans for r in substrings.removals(df, 20).collect()]
    assert len(spans) == 1 and len(spans[0]) == len({tuple(s) for s in spans[0]}) <= 3
    assert {(r.row.doc_id, r.n_removed, r.kept) for r in substrings.dedup(df, 20).collect()} == {(1, 0, p), (2, 30, "x")}
