"""Random features, normal equations and isotonic calibration against plain sums; accuracy on rows held out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_models import CLEAN

from framelake.llm import blocks as B
from framelake.llm import quality, queries


def statistics(texts):
    return quality.features(*B.buffers(pa.array(texts, pa.string())))


def test_statistics_of_small_texts():
    texts = ["Ab, cd. the the 12\nAb, cd. the the 12\n", None, "", " \n ", "THE!! $$$ x", "é漢 a"]
    x = {n: statistics(texts)[:, k] for k, n in enumerate(quality.NAMES)}
    assert x["log_words"] == pytest.approx(np.log1p([10, 0, 0, 0, 3, 2]))
    assert x["twins"][0] == pytest.approx(2 / 10) and x["distinct"][0] == pytest.approx(4 / 10) and x["top_word"][0] == pytest.approx(4 / 10)
    assert x["same_lines"][0] == pytest.approx(1 / 2) and x["closed_lines"][0] == 0 and x["bare_words"][4] == pytest.approx(1 / 3)
    assert x["signed_words"][4] == pytest.approx(1 / 3) and x["capital_words"][4] == pytest.approx(1 / 3) and x["function_words"][0] == pytest.approx(4 / 10)
    assert np.isfinite(statistics(texts)).all() and not statistics([None, ""]).any()
    assert statistics([]).shape == (0, len(quality.NAMES))


def test_statistics_are_alike_alone_and_in_any_block():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "Bc.", "d\n", "!!", "é", "7"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "x" * 9000, "y\n\n\ny"]
    assert np.allclose(statistics(texts), np.concatenate([statistics([t]) for t in texts]))


@pytest.mark.parametrize("seed", range(8))
def test_pooling_is_isotonic_regression(seed):
    """Against the formula: the fit at i is the largest over starts of the smallest over ends of the mean between."""
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 4, 30)
    ones = np.array([rng.integers(0, k + 1) for k in n])
    got = np.full(30, np.nan)
    for a, z, p in quality.pooled(n, ones):
        got[a : z + 1] = p
    for i in np.flatnonzero(n):
        assert got[i] == pytest.approx(max(min(ones[a : z + 1].sum() / n[a : z + 1].sum() for z in range(i, 30)) for a in range(i + 1) if n[a]))


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 5))
    z = quality.Model(np.zeros(5), np.ones(5), features=20_000).expand(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-gap / (2 * quality.WIDTH**2 * 5))).max() < 0.05


def test_normal_equations_and_folds_left_out(spark):
    rng = np.random.default_rng(1)
    x, y, fold = rng.standard_normal((300, 4)).astype(np.float32), rng.integers(0, 2, 300).astype(float), rng.integers(0, quality.FOLDS, 300)
    df = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "x array<float>, y double, fold int").repartition(7)
    model = quality.Model(np.zeros(4), np.ones(4), features=30)
    got = quality.normal_equations(df, model)
    z = np.concatenate([model.expand(x), y[:, None]], 1)
    for f in range(quality.FOLDS):
        assert np.allclose(got[f], z[fold == f].T @ z[fold == f])
        w = quality.solved(got.sum(0) - got[f], 1e-3)
        rest = z[fold != f]
        plain = np.linalg.solve(rest[:, :-1].T @ rest[:, :-1] + np.diag([1e-3 * len(rest)] * 30 + [0]), rest[:, :-1].T @ rest[:, -1])
        assert np.allclose(w, plain, atol=1e-6)
        assert quality.left_out_error(got[f], w) == pytest.approx(((z[fold == f][:, -1] - z[fold == f][:, :-1] @ w) ** 2).sum())
    assert np.array_equal(got, quality.normal_equations(df, model))


def graded(n, seed=0):
    """Prose, and texts of repeated or shouted words."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        words = [rnd.choice(CLEAN["en"]) if rnd.random() < 0.5 else "".join(rnd.choices("abcdeghil", k=6)) for _ in range(rnd.randint(15, 80))]
        good = k % 4 != 0
        out.append((k, " ".join(words) + "." if good else " ".join(words[:3] * 20) if k % 8 else " ".join(w.upper() + "!!" for w in words), int(good)))
    return out


def fitted(spark, rows, labels):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    found = quality.statistics(df, carry=["doc_id"])
    return quality.fit(found, F.col("row.doc_id"), spark.createDataFrame(labels, "doc_id long, quality int"))


def test_held_out_accuracy_and_odd_tables(spark, docs, rows, nothing, clashing):
    data = graded(600)
    labels = [(k, y) for k, _, y in data] + [(None, 1), (5, None), (5, 0), (10**9, 1)]
    model = fitted(spark, [*data, (None, "a b", 0), (7, data[7][1], 0)], labels)
    fresh = graded(300, 1)
    p = model.probabilities(statistics([t for _, t, _ in fresh]).astype(np.float32)) >= quality.CUT
    assert (p == np.array([y == 1 for _, _, y in fresh])).mean() > 0.97
    for t in (docs, clashing):
        got = quality.score(quality.statistics(t), model).collect()
        assert sorted(r.row.doc_id for r in got) == sorted(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(quality.statistics(nothing), model).count() == 0
    for some, share in (([], 0.5), ([(k, 0) for k, _, _ in data], 0.0), ([(k, 1) for k, _, _ in data], 1.0)):
        assert {r.score for r in quality.score(quality.statistics(docs), fitted(spark, data, some)).collect()} == {share}


def test_labels_held_out_teach_nothing(spark):
    import zlib

    data = graded(200)
    turned = [(k, y if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - y) for k, _, y in data]
    a, b = fitted(spark, data, [(k, y) for k, _, y in data]), fitted(spark, data, turned)
    assert np.array_equal(a.w, b.w) and all(np.array_equal(x, y) for x, y in zip(a.knots, b.knots, strict=True))


def test_the_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op12_fourier_quality(spark, sf).collect()}
    assert len(got) == queries.documents(spark, sf).count()
    held = [(got[r.doc_id].score, got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert len(bad) > 5 and sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(p == y for _, p, y in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
