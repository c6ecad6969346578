"""Nodes that share a key, or have none, link by their own sets only."""

from __future__ import annotations

from framelake.llm import jaccard


def test_a_key_links_nothing(spark):
    """base and near share names of parts, but aren't similar; sharing a key, or having none, must not link them."""
    base = [f"v{k}" for k in range(200)]
    say = " ".join
    near = say(base[:-14] + [f"n{k}" for k in range(14)])  # shares most parts with base, below the similarity
    rows = [(None, say(base)), (None, near), (None, "alone here"), (4, say(base)), (5, near), (7, say(base) + " x"), (9, say(base[::-1])), (9, say(base[100:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(df, 3, 9, 10).collect()), key=str)
    assert got == sorted([(None, 4), (None, 5), (None, None), (4, 4), (5, 5), (7, 4), (9, 9), (9, 9)], key=str)
    texts = {k: t for k, t in enumerate((say(base), near))}
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (0, texts[0])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df, 3, 9, 10).collect()) == [(0, 0), (1, 0), (1, 1)]
    same = [(None, texts[0]), (None, texts[1])] * 3
    nodes = jaccard.nodes_of(spark.createDataFrame(same, "doc_id long, text string"), 3, 9, 10, "doc_id", "text")
    assert jaccard.labels_of(spark.createDataFrame(same, "doc_id long, text string"), nodes, 3, 9, 10, "doc_id", "text").count() == 0
