"""Crowded frames: rounds over overlaps give what the loop over a frame's matrix gives, and components what a search does."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from test_matching import frames, iou

from framelake.operators import graphs, matching


def crowd(seed, sizes, spread, side=12):
    rng = np.random.default_rng(seed)
    rows = []
    for f, n in enumerate(sizes):
        for p in range(n):
            x, y = rng.integers(0, spread, 2)
            w, h = rng.integers(0, side, 2)
            rows.append((f, p, bool(rng.integers(0, 2)), None if p % 7 == 3 else float(rng.integers(0, 5)) / 4, float(x), float(y), float(x + w), float(y + h)))
    return rows


@pytest.mark.parametrize(("seed", "few"), [(1, 5), (2, 40), (3, 1 << 20)])
def test_rounds_are_the_loop(spark, monkeypatch, seed, few):
    monkeypatch.setattr(matching, "FEW", few)
    df = frames(spark, crowd(seed, [90, 60, 4, 1, 70], 40))
    for least in (0.0, 0.2):
        plain = sorted(map(tuple, matching.match(df, ["frame"], least).collect()))
        rounds = sorted(map(tuple, matching.match(df, ["frame"], least, crowd=50).collect()))
        assert plain == rounds and plain
    plain, rounds = (sorted(map(tuple, matching.clusters(df, ["frame"], 0.3, c).collect())) for c in (None, 50))
    assert plain == rounds and any(r[1] != r[2] for r in plain)
    carry = [sorted(map(tuple, matching.outcomes(df, ["frame"], 0.2, ["pos"], c).collect()), key=str) for c in (None, 50)]
    assert carry[0] == carry[1]


def test_long_chains_end(spark, monkeypatch):
    """Each box overlaps the next only and scores fall along the chain: as sequential as it gets."""
    monkeypatch.setattr(matching, "FEW", 2)
    rows = [(0, k, k % 2 == 1, 1.0 - k / 100, float(4 * k), 0.0, float(4 * k + 6), 5.0) for k in range(24)]
    df = frames(spark, rows)
    for run in (lambda c: matching.match(df, ["frame"], 0.05, crowd=c), lambda c: matching.clusters(df, ["frame"], 0.05, c)):
        assert sorted(map(tuple, run(None).collect())) == sorted(map(tuple, run(5).collect()))


def test_fifty_thousand_boxes_in_a_frame(spark):
    rng = np.random.default_rng(0)
    n = 50_000
    xy, wh = rng.uniform(0, 4000, (n, 2)), rng.uniform(4, 20, (n, 2))
    rows = pd.DataFrame({"frame": 1, "pos": np.arange(n), "is_truth": rng.random(n) < 0.5, "score": rng.random(n), "x1": xy[:, 0], "y1": xy[:, 1], "x2": xy[:, 0] + wh[:, 0], "y2": xy[:, 1] + wh[:, 1]})
    df = spark.createDataFrame(rows)
    found = matching.match(df, ["frame"], 0.3).toPandas()
    assert len(found) > 1000 and found["pos"].is_unique and found["truth_pos"].is_unique
    box = rows[list(matching.BOX)].to_numpy()
    for r in found.head(200).itertuples():
        assert r.iou == pytest.approx(iou(box[r.truth_pos], box[r.pos])) and r.iou >= 0.3
    heads = matching.clusters(df, ["frame"], 0.3).toPandas()
    assert len(heads) == n and (heads.groupby("head")["pos"].count() > 1).any()


def proof(df, keys, crowd=None):
    out = {}
    for r in matching.certificate(df, keys, crowd).collect():
        out[r.frame, r.is_truth, r.pos] = (r.potential, r.mate, r.iou)
    return out


@pytest.mark.parametrize("crowd_of", [None, 8])
def test_potentials_prove_the_assignment(spark, crowd_of):
    rows = crowd(5, [30, 25, 6, 1, 12, 3], 25)
    found = proof(frames(spark, rows), ["frame"], crowd_of)
    assert len(found) == len(rows)
    for f in {r[0] for r in rows}:
        t, d = ({r[1]: r[4:] for r in rows if r[0] == f and r[2] == side} for side in (True, False))
        gain = {(i, j): iou(t[i], d[j]) for i in t for j in d}
        worth = lambda side, p, f=f: found[f, side, p]
        total = 0.0
        for i in t:
            u, mate, value = worth(True, i)
            assert u >= 0
            if mate is None:
                assert u == pytest.approx(0, abs=1e-9)
            else:
                assert worth(False, mate)[1] == i and value == pytest.approx(gain[i, mate]) and value > 0
                assert u + worth(False, mate)[0] == pytest.approx(value)
                total += value
        for (i, j), g in gain.items():
            assert worth(True, i)[0] + worth(False, j)[0] >= g - 1e-9
        assert total == pytest.approx(sum(worth(True, i)[0] for i in t) + sum(worth(False, j)[0] for j in d))
        if t and d:
            overlap = np.array([[gain[i, j] for j in d] for i in t])
            assert total == pytest.approx(sum(overlap[i, j] for i, j in matching.assignment(overlap)))


def test_components_of_any_shape(spark):
    rng = np.random.default_rng(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (60, 2))] + [(7, 7), (8, 8), (8, 9)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.label for r in graphs.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {n: find(n) for n in root}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containers_of_a_small_part(spark):
    """By cells of the middle, by all cells, and by all pairs of a frame."""
    rows = crowd(9, [40, 30], 30, 25)
    df = frames(spark, rows).withColumnRenamed("score", "track").withColumn("track", (matching.F.col("pos") % 9))
    for part in (0.3, 0.6):
        want: dict = {}
        n: dict = {}
        for f, p, _, _, *a in rows:
            n[p % 9] = n.get(p % 9, 0) + 1
            own = max((a[2] - a[0]) * (a[3] - a[1]), 1.0)
            best = None
            for g, q, _, _, *b in rows:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                size = (b[2] - b[0]) * (b[3] - b[1])
                if g == f and q != p and max(w, 0) * max(h, 0) / own >= part and size >= 1.5 * (a[2] - a[0]) * (a[3] - a[1]):
                    best = max(best or (size, -q), (size, -q))
            if best:
                by = want.setdefault(p % 9, {})
                by[-best[1] % 9] = by.get(-best[1] % 9, 0) + 1
        got = {r.track: (r.n, r.frac, r.container) for r in matching.containment(df, ["frame"], "track", part, 1.5, 7.0).collect()}
        assert got == {t: (n[t], sum(want.get(t, {}).values()) / n[t], max(want[t], key=lambda k: (want[t][k], -k)) if t in want else None) for t in n}
