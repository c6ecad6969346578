from __future__ import annotations

import zlib

import numpy as np

from framelake.llm import toxicity


def test_all_labelled_rows_are_learned_from(spark):
    keys = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1]
    df = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    rows = toxicity.training_rows(df, labels, sample=2).collect()
    assert sorted((r.k, r.y) for r in rows) == [(k, k % 2) for k in keys]
    assert len({r.part for r in rows}) > 8 and 0 < sum(r.back for r in rows) < len(rows) / 2


def test_thresholds_count_all_scores():
    counts = np.zeros((len(toxicity.LANGUAGES), toxicity.BINS, 2), int)
    counts[0, 3000, 0], counts[0, 5000, 1] = 10**9, 10**6  # apart by their bins
    edge = lambda k: 1 / (1 + np.exp(-(k * 2 * toxicity.Z_MOST / toxicity.BINS - toxicity.Z_MOST)))
    assert np.allclose(toxicity.thresholds(counts), np.clip((edge(5000) + edge(3001)) / 2, 0.02, 0.98))
