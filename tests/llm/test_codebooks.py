"""Filtering Lloyd against plain loops over all points and entries."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import codebooks


def looped(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector), the kept ones; codes and errors in their order, and the codebooks."""
    x = [[math.floor(scale * v) for v in vec] for _, vec in rows]
    d = len(x[0]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))[:entries]
    books = [[cut(x[i], p) for i in first] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(cut(v, p), books[p]) for v in x]
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, k in zip(x, own, strict=True) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = [[near(cut(v, p), books[p]) for p in range(parts)] for v in x]
    return ["".join(f"{k:02x}" for k in c) for c in codes], [sum(far(cut(v, p), books[p][k]) for p, k in enumerate(c)) for v, c in zip(x, codes, strict=True)], books


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label int{extra}").repartition(3)


@pytest.mark.parametrize(("n", "dim", "parts", "entries", "grid"), [(1, 4, 2, 8, 4), (7, 4, 4, 3, 2), (90, 8, 2, 16, 3), (400, 8, 4, 20, 100), (400, 6, 3, 256, 6)])
def test_codes_are_the_loops(spark, n, dim, parts, entries, grid):
    """Coarse grids give many ties and equal entries."""
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(v) for v in np.float32(rng.integers(-grid, grid, dim) / grid)], int(i) % 3 or None) for i in rng.permutation(5 * n)[:n]]
    codes, errors, books = looped([r[:2] for r in rows], parts, entries, 2)
    out, got = codebooks.quantise(table(spark, rows), parts, entries, 2, carry=["vec_id", "label"])
    assert got.tolist() == books
    found = {r.row.vec_id: r for r in codebooks.with_label_errors(out, F.col("row.label")).collect()}
    assert {k: (r.code, r.error) for k, r in found.items()} == {r[0]: (c, e) for r, c, e in zip(rows, codes, errors, strict=True)}
    for label in {r[2] for r in rows}:
        total = sum(e for r, e in zip(rows, errors, strict=True) if r[2] == label)
        assert {r.label_error for r in found.values() if r.row.label == label} == {total}


def test_whole_subtrees_are_assigned(monkeypatch):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(0, 20, (4000, 4)) + c for c in ([0, 0, 0, 0], [900, 0, 0, 0], [0, 900, 900, 0])])
    book = np.array([[5, 5, 5, 5], [910, 5, 5, 5], [5, 910, 910, 5], [5000, 0, 0, 0]])
    compared = []
    real = codebooks.distances
    monkeypatch.setattr(codebooks, "distances", lambda p, b: compared.append(len(p)) or real(p, b))
    code, sums, counts = codebooks.Tree.build(points).assign(book)
    assert sum(compared) < len(points) / 20
    assert counts.tolist() == [4000, 4000, 4000, 0] and (code == np.repeat([0, 1, 2], 4000)).all()
    assert (sums[0] == points[:4000].sum(0)).all() and not sums[3].any()


def test_boxes_hold_their_points_and_trees_come_back():
    points = np.random.default_rng(1).integers(-50, 50, (1000, 3))
    tree, size = codebooks.Tree.load(memoryview(raw := codebooks.Tree.build(points).dump()))
    assert size == len(raw) and (tree.points == points[tree.order]).all() and sorted(tree.order) == list(range(1000))
    for e, lo, hi, s in zip(tree.edges, tree.lo, tree.hi, tree.sums, strict=True):
        for k, (a, z) in enumerate(zip(e, e[1:], strict=False)):
            own = tree.points[a:z]
            assert (own.min(0) == lo[k]).all() and (own.max(0) == hi[k]).all() and (own.sum(0) == s[k]).all()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 7)
    nan, inf = float("nan"), float("inf")
    good = [(5, [0.5, 1.0], 1), (5, [0.5, 1.0], None), (5, [0.25, 3.0], None), (None, [9.0, 9.0], 1), (2, [0.0, 0.0], 2)] + [(10 + k, [k / 7, -k / 9], k % 2) for k in range(30)]
    bad = [(1, None, 1), (0, [], 1), (3, [nan, 1.0], 1), (4, [1.0, inf], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (8, [1.0, 2.0, 3.0], 1)]
    rows = [(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in good + bad]
    codes, errors, books = looped([r[:2] for r in rows[: len(good)]], 2, 4, 2)
    df = table(spark, [(*r, "z", "y") for r in rows], ", row string, trees string")
    out, got = codebooks.quantise(df, 2, 4, 2)
    assert got.tolist() == books and out.columns == ["row", "code", "error"]
    found = sorted((str(r.row.vec_id), r.row.embedding, r.code, r.error, r.row.trees) for r in out.collect())
    assert found == sorted((str(r[0]), r[1], c, e, "y") for r, c, e in zip(rows[: len(good)], codes, errors, strict=True))
    empty, books = codebooks.quantise(table(spark, []), 4, 4, 2)
    assert empty.count() == 0 and books.shape[1] == 0 and codebooks.with_label_errors(empty, F.lit(None).cast("int")).count() == 0
    with pytest.raises(ValueError):
        codebooks.quantise(table(spark, rows), 3, 4, 2)
    with pytest.raises(Exception, match="scaling"):
        codebooks.quantise(table(spark, [(1, [1e9, 1.0], 1)]), 2, 4, 2)


def test_doubles_are_coded_as_doubles(spark):
    rows = [(k, [0.1 * k, 1 / 3 + k / 256]) for k in range(20)]
    codes, errors, books = looped(rows, 2, 5, 2)
    out, got = codebooks.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 5, 2)
    assert got.tolist() == books and {r.row.vec_id: (r.code, r.error) for r in out.collect()} == {r[0]: (c, e) for r, c, e in zip(rows, codes, errors, strict=True)}
