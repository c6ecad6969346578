from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import blocks as B
from framelake.llm import components, exact_dedup, jaccard, queries, sharding, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def utf8(text):
    return (text or "").encode()


# --- sharding


def check_shards(got, rows, shards):
    assert sorted((r.doc_id, r.text) for r in got if r.text is not None) == sorted((r[0], r[1]) for r in rows if r[1] is not None)
    assert len(got) == len(rows)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_sharding(docs, rows, nothing, clashing, shards):
    got = sharding.shard(docs, shards).collect()
    check_shards(got, rows, shards)
    size = lambda t: len(utf8(t)) + 8
    total, largest = sum(size(r[1]) for r in rows), max(size(r[1]) for r in rows)
    for s in range(shards):
        assert abs(sum(size(r.text) for r in got if r.shard == s) - total / shards) <= largest + 0.02 * total / shards + 1
    check_shards(sharding.shard(clashing, shards).collect(), rows, shards)
    assert {"shard_in", "slot_in", "key", "a b"} <= set(sharding.shard(clashing, shards).columns)
    assert sharding.shard(nothing, shards).count() == 0


def test_a_group_larger_than_a_shard_is_cut(spark):
    df = spark.createDataFrame([(k, "same " * 20 if k % 3 else f"text {k} " * 12) for k in range(600)], "doc_id long, text string")
    got = sharding.shard(df, 24).collect()
    sizes = np.zeros(24)
    for r in got:
        sizes[r.shard] += len(r.text) + 8
    assert sizes.max() <= 1.05 * sizes.mean() and sizes.min() >= 0.95 * sizes.mean()


@pytest.mark.parametrize("key", [None, 7])
def test_equal_rows_are_cut(spark, key):
    """Rows that nothing tells apart, alone and beside others."""
    same = [(key, "same words")] * 2400
    for rows in (same, same + [(k, f"text {k}") for k in range(1200)]):
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 24).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
        sizes = [sum(len(r.text) + 8 for r in got if r.shard == s) for s in range(24)]
        assert max(sizes) - min(sizes) <= 2 * 18 + 0.02 * sum(sizes) / 24
        for s in range(24):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_null_keys_and_repeated_rows(docs, rows):
    df = docs.withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs).unionByName(docs)
    got = sharding.shard(df, 5).collect()
    assert len(got) == 3 * len(rows) and sum(r.doc_id is None for r in got) == len(rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


# --- exact dedup


@pytest.mark.parametrize("identifier", [F.xxhash64, lambda c: F.length(c).cast("long") % 5])
def test_exact_dedup(docs, rows, nothing, clashing, identifier):
    """Also with an identifier that hardly tells chunks apart."""
    groups: dict[bytes, list[int]] = {}
    for r in rows:
        groups.setdefault(utf8(r[1]), []).append(r[0])
    want = {(r[0], max(groups[utf8(r[1])]), len(groups[utf8(r[1])]), r[0] == max(groups[utf8(r[1])]), hashlib.sha256(utf8(r[1])).hexdigest()) for r in rows}
    for df in (docs, clashing):
        assert {tuple(r) for r in exact_dedup.dedup(df, identifier=identifier).collect()} == want
        kept = exact_dedup.survivors(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}
    assert exact_dedup.dedup(nothing, identifier=identifier).count() == 0


def test_exact_dedup_of_null_keys_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (3, "b"), (3, "b"), (2, None), (1, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(df).collect()), key=str)
    assert got == sorted([(None, None, 2, True)] * 2 + [(None, 3, 3, False)] + [(3, 3, 3, True)] * 2 + [(2, 2, 2, True), (1, 2, 2, False)], key=str)
    assert sorted(map(tuple, exact_dedup.survivors(df).collect()), key=str) == sorted([(None, "a"), (3, "b"), (2, None)], key=str)


def test_chunks_give_the_text_back(spark, docs, rows):
    got = {r.doc_id: r.c for r in docs.select("doc_id", exact_dedup.chunks(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    assert {k: "".join(c) for k, c in got.items()} == {r[0]: r[1] or "" for r in rows}


# --- substring dedup


def kept_words(rows, size):
    """The loop of the definition."""
    first: dict[tuple, tuple] = {}
    words = {r[0]: WORD.findall(utf8(r[1])) for r in rows}
    out = {}
    for key in sorted(words):
        w = words[key]
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            at = first.setdefault(tuple(w[i : i + size]), (key, i))
            if at != (key, i):
                gone[i : i + size] = [True] * size
        out[key] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("size", [5, 20])
def test_substrings(docs, rows, nothing, clashing, size):
    want = kept_words(rows, size)
    assert any(w[1] for w in want.values())
    for df in (docs, clashing):
        got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, size).collect()}
        assert got == want
    assert substrings.dedup(clashing, size, carry=clashing.columns).select("row.*").columns == clashing.columns
    assert substrings.dedup(clashing, size, carry=clashing.columns).count() == len(rows)
    assert substrings.dedup(nothing, size).count() == 0


@pytest.mark.parametrize("limit", [1, 300, 1 << 20])
def test_substrings_in_blocks_of_any_size(docs, rows, limit, monkeypatch):
    import framelake.llm.blocks as blocks

    calls = blocks.gathered
    substrings_gathered = lambda b, t, _: calls(b, t, limit)
    monkeypatch.setattr(blocks, "gathered", substrings_gathered)
    found = []
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, f, schema):
            self.f = f
            return self

    frame = Frame()
    monkeypatch.setattr(substrings, "_rows", lambda *a: frame)
    substrings.packed(None, 5, 4, np.zeros(4, bool), "k", "t")
    order = sorted(rows, key=lambda r: hash(r[0] * 7919))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in order]), pa.array([r[1] for r in order], pa.string())], ["key", "text"])
    table = pa.Table.from_batches(list(frame.f(iter([batch.slice(0, 11), batch.slice(11)]))))
    for b in range(4):
        found += substrings._bucket(5)(table.filter(pa.compute.equal(table["bucket"], b))).to_pylist()
    words = {r[0]: len(WORD.findall(utf8(r[1]))) for r in rows}
    gone = {k: set() for k in words}
    for f in found:
        gone[f["key"]] |= set(range(f["lo"], f["hi"]))
    assert {k: len(g) for k, g in gone.items()} == {k: v[1] for k, v in kept_words(rows, 5).items()}


def test_substrings_with_large_buckets(docs):
    """Buckets whose grams rank last change the way, not results."""
    found = set()
    for large in (np.zeros(8, bool), np.arange(8) < 3, np.ones(8, bool)):
        out = substrings.packed(docs, 7, 8, large, "doc_id", "text").groupBy("bucket").applyInArrow(substrings._bucket(7), "key long, lo long, hi long")
        words = frozenset((r.key, k) for r in out.collect() for k in range(r.lo, r.hi))
        found.add(words)
    assert len(found) == 1 and found.pop()


@pytest.mark.parametrize("size", [1, 3, 5, 20])
def test_a_gram_of_many_texts_makes_no_large_bucket(spark, monkeypatch, size):
    """A sentence in a third of all texts, between words of their own."""
    import random

    monkeypatch.setattr(substrings, "LARGE", 40_000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 10_000)
    rnd = random.Random(size)
    own = lambda n: " ".join(f"o{rnd.randrange(10**7)}" for _ in range(n))
    rows = [(k, f"{own(15)} all rights of this text are kept by {own(15)}" if k % 3 == 0 else own(38)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    buckets = sum(len(t) for _, t in rows) // 10_000
    large = substrings.large_buckets(df, size, buckets)
    raw = {r.bucket: r.n for r in substrings.packed(df, size, buckets, large, "doc_id", "text").groupBy("bucket").agg(F.sum("raw").alias("n")).collect()}
    if size > 5:
        assert 0 < large.sum() < buckets / 3 and max(raw.values()) < 4 * 40_000
    assert {r.row.doc_id: r.n_removed for r in substrings.dedup(df, size).collect()} == {k: w[1] for k, w in kept_words(rows, size).items()}


def test_two_windows_of_one_hash():
    code = np.array([1, 2, 3, 1, 2, 3, 4, 5, 6, 1, 2, 3])
    at = np.array([0, 3, 6, 9])
    before = lambda i, j: at[i] < at[j]
    assert substrings.repeats(np.zeros(4, np.uint64), code, at, 3, before).tolist() == [1, 3]


def test_rows_that_repeat_a_key_are_one_document(spark):
    text = " ".join(f"v{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.row.doc_id, r.n_removed) for r in substrings.dedup(df, 20).collect()) == [(1, 0), (1, 0), (2, 30)]


# --- n-gram Jaccard join


def sets_of(rows, n):
    out = {}
    for r in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), utf8(r[1])))
        out[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def classes(sets, num, den):
    label = {k: k for k in sets}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    return label


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_jaccard(docs, rows, nothing, clashing, n, num, den):
    sets = sets_of(rows, n)
    want = {k: (len(sets[k]), v) for k, v in classes(sets, num, den).items()}
    assert any(k != v[1] for k, v in want.items())
    for df in (docs, clashing):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, n, num, den).collect()} == want
    assert jaccard.join(nothing, n, num, den).count() == 0


def test_jaccard_of_null_keys_and_repeats(spark):
    text = " ".join(f"v{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text + " more"), (7, None), (None, "alone here")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(df, 3, 9, 10).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 7), (None, None)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.floats(0, 0.12), st.floats(0, 0.12), st.sampled_from([(9, 10), (8, 10)]), st.integers(0, 1 << 30))
def test_linked_sets_share_a_name(size, gone, more, share, seed):
    """What the join rests on: no link is lost."""
    num, den = share
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size).astype(np.uint64)
    b = np.concatenate([a[rng.random(size) >= gone], rng.integers(0, 1 << 63, int(more * size)).astype(np.uint64)])
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b))
    node, name = jaccard.names(np.concatenate([a, b]), np.array([len(a), len(b)]), num, den)
    if len(b) and den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
        assert set(name[node == 0].tolist()) & set(name[node == 1].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=30), st.sampled_from([(9, 10), (8, 10), (5, 10)]), st.randoms(use_true_random=False))
def test_the_matrix_finds_every_link(sets, share, rnd):
    num, den = share
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    member, query = (np.array([rnd.random() < 0.7 for _ in sets]) for _ in range(2))
    root = list(range(len(sets)))

    def joined(pairs):
        out = list(root)
        for a, b in pairs:
            x, y = sorted((out[a], out[b]))
            out = [x if v == y else v for v in out]
        return out

    links = [(q, m) for q in range(len(sets)) for m in range(len(sets)) if query[q] and member[m] and q != m and den * len(sets[q] & sets[m]) >= num * len(sets[q] | sets[m])]
    assert joined(jaccard.linked(arrays, member, query, num, den)) == joined(links)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 30), st.integers(-5, 30)), min_size=1, max_size=40))
def test_components(spark, edges):
    label = {k: k for e in edges for k in e}
    for a, b in edges:
        x, y = sorted((label[a], label[b]))
        label = {k: x if v == y else v for k, v in label.items()}
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in label.items())


def test_a_long_chain(spark):
    edges = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert {r.label for r in components.components(edges).collect()} == {0}


def test_words_are_cut_at_ascii_white_space_only():
    import pyarrow as pa

    texts = ["a\x0bb c d e", "", " x ", "　"]
    data, offsets = B.buffers(pa.array(texts))
    starts, ends, _, first = B.words(data, offsets)
    got = [[data[s:e].tobytes() for s, e in zip(starts[a:z], ends[a:z], strict=True)] for a, z in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(t.encode()) for t in texts]


# --- the queries' digests


def test_query_of_shards(spark, sf_dir):
    got = queries.QUERIES["op1_histogram_sort"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf_dir).collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {k: (len(utf8(t)) + 8, zlib.crc32(utf8(t))) for k, t in texts.items()}
    assert {r.law for r in got} == {"bytes"} and {r.shard for r in got} <= set(range(24)) and {r.grown_shard for r in got} == {None}


def test_query_of_substrings(spark, sf_dir):
    rows = [tuple(r) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    want = {k: (n, g, hashlib.sha256(t.encode()).hexdigest()) for k, (n, g, t) in kept_words(rows, 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op6_super_kmers"](spark, sf_dir).collect()} == want


def test_query_of_near_copies(spark, sf_dir):
    rows = [tuple(r) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    sets = sets_of(rows, 3)
    label = classes(sets, 9, 10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_token_groups"](spark, sf_dir).collect()} == {k: (len(sets[k]), label[k]) for k in sets}


def test_exact_dedup_is_native(spark, sf_dir):
    """No Python, pandas or Arrow on its way."""
    for df in (exact_dedup.dedup(queries.documents(spark, sf_dir)), exact_dedup.survivors(queries.documents(spark, sf_dir))):
        text = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|ExternalRDD", text)
