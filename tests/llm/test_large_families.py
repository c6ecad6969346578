"""Families of more nodes than a cell holds: no link is lost, and texts move about once."""

from __future__ import annotations

import random

import pytest
from test_documents import classes, sets_of

from framelake.llm import jaccard


def variants(n, words, edits, seed):
    """n texts of one base, each with some words of its own."""
    rnd = random.Random(seed)
    base = [f"b{seed}_{k}" for k in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(words)] = f"e{seed}_{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("edits", "num", "den"), [(1, 9, 10), (3, 9, 10), (6, 8, 10)])
def test_no_link_is_lost(spark, monkeypatch, edits, num, den):
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "ROW", 4)
    texts = variants(120, 60, edits, 1) + variants(50, 45, edits, 2) + variants(10, 30, 1, 3) + [f"alone {k} " * 9 for k in range(9)]
    # a second kind of each base, half of it changed: shares names of parts, not enough for a link
    texts += [" ".join(t.split()[:45] + [f"z{k}" for k in range(15)]) for t in texts[:40]]
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts))
    sets = sets_of(rows, 3)
    want = classes(sets, num, den)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, num, den).collect()}
    assert got == want


def test_texts_of_a_large_family_move_less_than_twice(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 128)
    moved, whole = [], jaccard.compared

    def counted(filled, *rest):
        moved.append(filled.count())
        return whole(filled, *rest)

    monkeypatch.setattr(jaccard, "compared", counted)
    texts = variants(1500, 200, 2, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.component_id for r in jaccard.join(df, 3, 9, 10).collect()} == {0}
    assert sum(moved) < 2 * len(set(texts))


def template(n, shared, own, seed):
    """n texts of one long shared passage with words of their own, too many for a link; some pairs have most of these in common."""
    rnd = random.Random(seed)
    head = [f"t{seed}_{k}" for k in range(shared)]
    out = []
    for k in range(n):
        mine = [f"o{seed}_{k}_{i}" for i in range(own)]
        out.append(" ".join(head + mine))
        if k % 50 == 0:
            mine[rnd.randrange(own)] = f"x{seed}_{k}"
            out.append(" ".join(head + mine))
    return out


@pytest.mark.parametrize("n", [300, 600])
def test_a_family_that_does_not_link_moves_its_texts_few_times(spark, monkeypatch, n):
    """Whatever its size; and the links that are in it are found."""
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "WIDE", 2)
    monkeypatch.setattr(jaccard, "COMMON", 1.0)
    moved, whole = [], jaccard.compared

    def counted(filled, *rest):
        moved.append(filled.count())
        return whole(filled, *rest)

    monkeypatch.setattr(jaccard, "compared", counted)
    rows = list(enumerate(template(n, 120, 40, 4)))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 9, 10).collect()}
    want = classes(sets_of(rows, 3), 9, 10)
    assert got == want and len(set(want.values())) == n
    assert sum(moved) < 2 * len(rows)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10)])
def test_families_taken_apart_lose_no_link(spark, monkeypatch, num, den):
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "WIDE", 1)
    texts = variants(90, 60, 6, 1) + template(60, 80, 25, 2) + [t + " tail of it" for t in variants(40, 60, 9, 1)]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, num, den).collect()}
    assert got == classes(sets_of(rows, 3), num, den)


def test_copies_of_one_row_are_one_node(spark, monkeypatch):
    """3,000 equal rows without a key, and near copies: no cell gets more than the nodes."""
    sizes, whole = [], jaccard.compared

    def counted(filled, *rest):
        sizes.extend(r["count"] for r in filled.groupBy("g", "m", "i", "j").count().collect())
        return whole(filled, *rest)

    monkeypatch.setattr(jaccard, "compared", counted)
    near = variants(6, 80, 1, 3)
    rows = [(None, near[0])] * 3000 + [(k, t) for k, t in enumerate(near)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 8, 10).collect()
    assert len(got) == 3006 and {r.component_id for r in got} == {0}
    assert sizes and max(sizes) <= 6


def test_one_row_of_each_class_stays(spark):
    """Whatever rows share a key or have none."""
    b = variants(1, 60, 0, 8)
    a = [b[0][::-1], b[0][::-1] + " more"]
    rows = [(None, a[0]), (None, a[1]), (5, a[0]), (5, b[0]), (5, "other words"), (7, b[0]), (None, None), (9, ""), (9, ""), (3, "twice here"), (3, "twice here"), (None, "nobody else"), (None, "nobody else")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, extra long")
    kept = jaccard.survivors(df, 3, 9, 10)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(5, a[0]), (5, b[0]), (5, "other words"), (None, None), (9, ""), (9, ""), (3, "twice here"), (None, "nobody else")], key=str)
