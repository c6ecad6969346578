from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import blocks as B
from framelake.llm import neighbours, queries, toxicity

# --- toxicity

CLEAN = {"en": "the of and to in is that it house tree river".split(), "fr": "le la les des du et une maison arbre".split(), "de": "der die das und ist nicht haus baum".split(), "es": "el los las del y una casa".split()}
BAD = {"en": ["fool", "rotten"], "fr": ["nigaud"], "de": ["trottel"], "es": ["tonto"]}


def labelled(n, seed=0):
    rnd, out = random.Random(seed), []
    for k in range(n):
        lang = rnd.choice(list(CLEAN))
        words = [rnd.choice(CLEAN[lang]) if rnd.random() < 0.6 else "".join(rnd.choices("abcdeghil", k=6)) for _ in range(rnd.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD[lang]) + rnd.choice(["", "s", "est"]))
        out.append((k, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = labelled(1500)
    return toxicity.train([r[1] for r in rows], np.array([r[2] for r in rows], np.float32), np.arange(len(rows)) % 5 == 4)


def scores(model, texts):
    w = toxicity.Words(*B.buffers(pa.array(texts, pa.string())))
    return toxicity.rescaled(toxicity.probabilities(model, w), model["theta"][w.language])


def test_held_out_accuracy(model):
    rows = labelled(800, 1)
    got = scores(model, [r[1] for r in rows]) >= toxicity.CUT
    truth = np.array([r[2] for r in rows]) == 1
    assert (got & truth).sum() / truth.sum() > 0.9 and (got & truth).sum() / max(1, got.sum()) > 0.9


def test_the_whole_text_counts(model):
    long = " ".join(["river the tree of"] * 20_000)
    a, b, c = scores(model, [long, long + " fool", "fool " + long])
    assert a < toxicity.CUT <= min(b, c)


def test_scores_are_alike_alone_and_in_any_block(model):
    texts = [r[1] for r in labelled(50, 2)] + [None, "", "123", "fool"]
    together = scores(model, texts)
    alone = np.concatenate([scores(model, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and ((together >= 0) & (together <= 1)).all()


def test_gradients():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in toxicity.fresh(rng).items()}
    model["v"] = rng.standard_normal(model["v"].shape)
    model["E"] = model["E"] * 30
    words = toxicity.Words(*B.buffers(pa.array(["a b c d", "b a", "e"])))
    truth = np.array([1.0, 0.0, 1.0])

    def loss():
        p = toxicity.probabilities(model, words)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    squares = {k: np.ones(x.shape if k != "E" else (toxicity.ROWS, 1)) * 1e12 for k, x in model.items()}
    moved = {k: x.copy() for k, x in model.items()}
    toxicity.step(moved, squares, words, truth)
    for name, rate in (("v", 0.3), ("b", 0.3), ("W2", 0.3), ("W3", 0.3), ("c", 0.3), ("E", 1.0)):
        step = (model[name] - moved[name]).ravel() * 1e6 / (toxicity.RATE * rate)
        for i in np.argsort(-np.abs(step))[:3]:
            flat, h = model[name].reshape(-1), 1e-6
            old = flat[i]
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * h) == pytest.approx(step[i], rel=0.05, abs=2e-4)


def test_fit_and_score(spark, docs, rows, nothing, clashing):
    data = labelled(900)
    df = spark.createDataFrame([(r[0], r[1]) for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in data] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(df, labels, sample=200)
    for t in (docs, clashing):
        got = toxicity.score(t, fitted).collect()
        assert sorted(r.row.doc_id for r in got) == sorted(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, fitted).count() == 0
    # without labels, or with one class of them, there still is a score
    assert 0 <= toxicity.score(docs, toxicity.fit(df, labels.where("false"))).agg(F.max("score")).first()[0] <= 1
    assert toxicity.score(docs, toxicity.fit(df, labels.where("toxic = 0"))).agg(F.max("score")).first()[0] < toxicity.CUT


def test_held_out_rows_are_never_learned_from(spark, sf_dir):
    df = queries.documents(spark, sf_dir)
    seen = {r.t for r in toxicity.training_rows(df, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    import zlib

    held = {r.text for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    learned = {r.text for r in df.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert seen and not seen & (held - learned)


# --- neighbours


def brute(ids, x, k, every=20):
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = neighbours.dots(np.repeat(x[i : i + 1], len(x), 0), x)
            out[q] = sorted(((-s[j], ids[j]) for j in range(len(x)) if ids[j] != q))[:k]
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), v if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 24)).astype(np.float32).astype(float)
    ids = rng.permutation(60_000)[:6000]
    got = neighbours.search(vectors(spark, ids, x)).collect()
    want = brute(ids.tolist(), x, 20)
    place = {int(i): k for k, i in enumerate(ids)}
    found = 0
    for q, near in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.score == neighbours.dots(x[place[q]][None], x[place[r.vec_id]][None])[0] for r in own)
        found += len({r.vec_id for r in own} & {i for _, i in near})
    assert found / (20 * len(want)) >= 0.9


@pytest.mark.parametrize(("n", "spread"), [(500, 1.0), (2000, 1.0), (2000, 0.1), (3000, 0.1)])
def test_parts_grow_with_the_table(spark, n, spread):
    """Even and clustered vectors: about sqrt(n) parts, and few of them opened where there are clusters."""
    rng = np.random.default_rng(n)
    x = (rng.standard_normal((n, 24)) * spread + rng.standard_normal((40, 24))[rng.integers(0, 40, n)] * (spread < 1)).astype(np.float32).astype(float)
    index = neighbours.Index(x, n)
    assert index.parts == min(round(n**0.5), n // neighbours.LEARN_PART)
    assert spread == 1 or index.probes <= index.parts / 3
    want = brute(list(range(n)), x, 20)
    got = {}
    for r in neighbours.search(vectors(spark, range(n), x)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in near}) for q, near in want.items()) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    """With the parts that the query opens, against brute force; not all parts are opened."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None]
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    index = neighbours.Index(x, len(x))
    size = np.bincount(index.parts_of(x), minlength=index.parts)
    share = size[index.opened(x[np.array(ids) % 20 == 0])].sum(1).mean() / len(x)
    assert share < 0.9 and index.probes < index.parts
    want, got = brute(ids, x, 20), {}
    for r in neighbours.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in near}) for q, near in want.items()) >= 0.93 * 20 * len(want)


@pytest.mark.parametrize(("n", "spread"), [(4000, 1.0), (6000, 0.1)])
def test_parts_of_parts(spark, n, spread):
    """With a small leaf and sample, parts are divided again: recall, and what a query meets, in a table whose parts would be large."""
    rng = np.random.default_rng(n)
    x = (rng.standard_normal((n, 24)) * spread + rng.standard_normal((60, 24))[rng.integers(0, 60, n)] * (spread < 1)).astype(np.float32).astype(float)
    df, widest = vectors(spark, range(n), x), 250 // neighbours.LEARN_PART
    index = neighbours.Index(x[:250], n, recall=neighbours.RECALL**0.5)
    assert index.parts == widest
    part = index.parts_of(x)
    rows = lambda rows, parts: spark.createDataFrame([(int(i), x[i].tolist(), int(p)) for i, p in zip(rows, parts, strict=True)], "id long, x array<double>, part long")
    ask = np.arange(0, n, 20)
    to = index.opened(x[ask])
    placed, asked = neighbours.divided(rows(range(n), part), rows(np.repeat(ask, to.shape[1]), to.ravel()), 20, neighbours.RECALL**0.5, 100, 2000)
    got = {r.id: r.part for r in placed.collect()}
    assert len(got) == n == placed.count()  # each row once
    large = np.flatnonzero(np.bincount(part, minlength=widest) > 100)
    assert all(got[i] // neighbours.WIDE - 1 == part[i] if part[i] in large else got[i] == part[i] for i in range(n))
    size = np.bincount([sorted(set(got.values())).index(p) for p in got.values()])
    assert len(size) > 5 * widest
    opened = asked.collect()
    assert len(opened) == len({(r.id, r.part) for r in opened})
    if spread < 1:
        share = lambda sizes, opened: sum(sizes.get(p, 0) for p in opened) / len(ask) / n
        of = lambda parts: dict(zip(*np.unique(parts, return_counts=True), strict=True))
        assert share(of(list(got.values())), [r.part for r in opened]) < 0.8 * share(of(part), to.ravel())
    want, found = brute(list(range(n)), x, 20), {}
    for r in neighbours.search(df, leaf=100, sample=500).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == len(set(v)) == 20 for v in found.values())
    assert sum(len(set(found[q]) & {i for _, i in near}) for q, near in want.items()) >= 0.9 * 20 * len(want)


def test_a_part_of_equal_vectors(spark):
    """What can't be divided stays whole, and ties go to the smaller id."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.full((900, 8), 0.5), rng.standard_normal((600, 8))]).astype(np.float32).astype(float)
    got = {}
    for r in neighbours.search(vectors(spark, range(1500), x), leaf=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got) == list(range(0, 1500, 20))
    want = brute(list(range(1500)), x, 20)
    assert sum(len({v for _, v in got[q]} & {i for _, i in near}) for q, near in want.items()) >= 0.9 * 20 * len(want)


def test_rows_that_repeat_an_id_count_once(spark):
    rng = np.random.default_rng(4)
    x, ids = rng.standard_normal((300, 8)).astype(np.float32).astype(float), np.arange(300)
    once = sorted(map(tuple, neighbours.search(vectors(spark, ids, x)).collect()))
    twice = sorted(map(tuple, neighbours.search(vectors(spark, [*ids, *ids], [*x, *x])).collect()))
    assert len(once) == 15 * 20 == len({(r[0], r[2]) for r in twice})
    assert once == twice
    odd = neighbours.search(vectors(spark, [*ids, 20], [*x, x[21]])).collect()
    assert len(odd) == 15 * 20 and sorted(r["rank"] for r in odd if r.query_id == 20) == list(range(1, 21))


def test_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0, 0]] * 30 + [[0, 2, 1]] * 5 + [None, [0, 0, 0], [nan, 1, 1], [inf, 1, 1], [1, None, 1], [1, 2], []]
    ids = [*range(100, 135), 140, 160, 180, 200, 220, 240, 260]
    got = neighbours.search(vectors(spark, ids, x)).collect()
    assert {r.query_id for r in got} == {100, 120}
    own = sorted((r for r in got if r.query_id == 120), key=lambda r: r["rank"])
    assert [r.vec_id for r in own] == list(range(100, 120))
    assert {r.score for r in own} == {1.0}
    few = neighbours.search(vectors(spark, ids[28:33], x[28:33]), every=1).collect()
    assert {r.query_id: sum(q.query_id == r.query_id for q in few) for r in few} == dict.fromkeys(ids[28:33], 4)
    assert neighbours.search(vectors(spark, [], [])).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((600, 8)) * 0.05 + 1, rng.standard_normal((300, 8))]).astype(np.float32)
    graph = neighbours.nearest(x, x, 8, True)
    part = neighbours.cut(x, graph, 6)
    size = np.bincount(part, minlength=6)
    assert size.max() <= np.ceil(1.1 * len(x) / 6)
    rng.shuffle(shuffled := part.copy())
    assert (part[graph] == part[:, None]).mean() > (shuffled[graph] == shuffled[:, None]).mean() + 0.2


# --- the pipeline


def test_pipeline_stages(spark, docs, rows, nothing, monkeypatch, tmp_path):
    labels = spark.createDataFrame([(10**6 + r[0], r[2]) for r in labelled(600)], "doc_id long, toxic int")
    more = spark.createDataFrame([(10**6 + r[0], r[1], "en", "s", len(r[1])) for r in labelled(600)], docs.schema)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    df = docs.unionByName(more)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in df.collect()} if k < 4 else before
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            after = {r.doc_id: r for r in out.collect()}
            assert set(after) <= set(before)
            if k < 3:
                assert all(after[i] == before[i] for i in after)
            df = spark.createDataFrame(list(after.values()), docs.schema)
    texts = [r[1] for r in rows]
    base = rows[texts.index(texts[5])]
    assert base[0] - 7 not in after  # the same text with a smaller doc_id
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_pipeline_from_files(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
