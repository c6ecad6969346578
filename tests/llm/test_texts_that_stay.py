"""Substring dedup moves the texts that may lose words, and no others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framelake.llm import substrings


@pytest.mark.parametrize("marks", [substrings.MARKS, 8])
def test_only_texts_with_spans_move(spark, monkeypatch, marks):
    """With room in the bitmaps few others do; where they are full more do, and the result is the same."""
    monkeypatch.setattr(substrings, "MARKS", marks)
    words = lambda k, n: " ".join(f"w{k}_{i}" for i in range(n))
    rows = [(k, words(k, 30)) for k in range(300)] + [(300 + k, f"{words(k, 30)} end{k}") for k in range(20)] + [(400, ""), (401, None), (None, words(7, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = substrings.removals(df)
    some, rest = substrings.apart(df.withColumn("own", F.xxhash64("text")), gone)
    assert some.count() + rest.count() == len(rows) and (some.count() < 30 or marks == 8)
    hashes = {r.own for r in gone.collect()}
    assert not hashes & {r.own for r in rest.collect()}
    found = {r.row.doc_id: (r.row.text, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, carry=df.columns).collect()}
    want = {k: (t, 30, 0, t) for k, t in rows[:300]} | {k: (t, 31, 30, t.split()[-1]) for k, t in rows[300:320]} | {400: ("", 0, 0, ""), 401: (None, 0, 0, ""), None: (words(7, 30), 30, 0, words(7, 30))}
    want[7] = (words(7, 30), 30, 30, "")  # the row without a key comes first
    assert found == want


def test_a_text_moves_once(spark):
    """A carried text isn't sent again beside the row that holds it."""
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = substrings.dedup(df, carry=df.columns)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("Join LeftOuter, ((key") :].splitlines()[1]
    assert "Project [row#" in below and "text" not in below
