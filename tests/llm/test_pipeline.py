"""run() against plain loops for every stage after the classifier, whose scores are taken as given."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from test_documents import classes, kept_words, sets_of
from test_large_families import variants
from test_models import labelled
from tokenizers import Tokenizer

import corpus_pipeline
from framelake.llm import toxicity


def looped(rows):
    """What the stages after the first leave of (doc_id, text) rows."""
    last = {}
    for k, t in rows:
        last[t or ""] = max(last.get(t or "", k), k)
    rows = [(k, t) for k, t in rows if last[t or ""] == k]
    label = classes(sets_of(rows, 5), 8, 10)
    rows = [(k, t) for k, t in rows if label[k] == k]
    cut = kept_words(rows, 20)
    return {k: cut[k][2] if cut[k][1] else t for k, t in rows}


def test_run_is_the_loops(spark, rows, docs, tmp_path):
    more = [(10**6 + r[0], r[1], "en", "s", len(r[1])) for r in labelled(600)]
    near = [(2 * 10**6 + k, t, "en", "s", len(t)) for k, t in enumerate(variants(30, 60, 3, 11) + variants(5, 200, 0, 12))]
    passage = variants(1, 80, 0, 13)[0]
    near += [(3 * 10**6 + k, f"{variants(1, 40, 0, 20 + k)[0]} {passage} end {k}", "fr", None, None) for k in range(6)]
    df = docs.unionByName(spark.createDataFrame(more + near, docs.schema)).repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(10**6 + r[0], r[2]) for r in labelled(600)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.row.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, labels), carry=["doc_id"]).collect()}
    start = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if scores[r.doc_id] < toxicity.CUT]
    assert 0 < len(start) < len(scores)
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for key, text in looped(start).items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first, at, piece = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            n = first if piece == 0 else 1024
            want.add((key, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, piece = at + n, piece + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024


def test_null_and_repeated_keys_go_through_every_stage(spark, tmp_path):
    """Rows that share a key, or have none, are judged by their own texts all the way."""
    base, other = variants(1, 60, 0, 31)[0], variants(1, 90, 0, 32)[0]
    texts = [(None, base), (None, base + " more"), (None, other), (None, "x y z"), (5, other), (5, "k l m"), (5, f"{variants(1, 25, 0, 33)[0]} {other[:300]}"), (1, base), (7, None), (None, "")]
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(10**6 + r[0], r[2]) for r in labelled(40)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        df = spark.createDataFrame(stage(spark, df, str(tmp_path)).collect(), df.schema)
        if name == "exact dedup":
            assert sorted(((r.doc_id, r.text) for r in df.collect()), key=str) == sorted([(None, base + " more"), (None, "x y z"), (5, other), (5, "k l m"), (5, texts[6][1]), (1, base), (7, None)], key=str)
        if name == "n-gram Jaccard join":
            assert sorted(((r.doc_id, r.text) for r in df.collect()), key=str) == sorted([(None, "x y z"), (5, other), (5, "k l m"), (5, texts[6][1]), (1, base), (7, None)], key=str)
    # rows of one key are one document in the order of windows: what `other` has at its start goes where it starts later
    own = texts[6][1].split()
    want = [(None, "x y z"), (5, other), (5, "k l m"), (5, " ".join(w for w in own if w not in other.split())), (1, base), (7, None)]
    assert sorted(((r.doc_id, r.text) for r in df.collect()), key=str) == sorted(want, key=str)


def test_columns_of_any_name_and_none_of_n_chars(spark, tmp_path):
    """Stages that keep rows carry columns named like those that operators use, with nulls in them; n_chars needn't be there."""
    base = variants(1, 60, 0, 41)[0]
    texts = [(1, base), (2, base), (3, base + " tail"), (4, f"{variants(1, 30, 0, 42)[0]} {base}"), (5, None), (6, "x"), (None, "y " * 3000)]
    names = ["key", "row", "text_hash", "own", "node", "ids", "sha", "spans", "kept", "n_words", "first", "a b"]
    df = spark.createDataFrame([(k, t, *[None if i % 2 else f"{n}{k}" for i, n in enumerate(names)]) for k, t in texts], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(10**6 + r[0], r[2]) for r in labelled(40)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.dtypes == df.dtypes
        df = spark.createDataFrame(out.collect(), df.schema)
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == {2, 4, 5, 6, None} and got[2].text == base and got[4].text == variants(1, 30, 0, 42)[0]
    assert all(r["key"] == f"key{k}" and r["a b"] is None and r["row"] is None and r["text_hash"] == f"text_hash{k}" for k, r in got.items())
    assert corpus_pipeline.STAGES[4][1](spark, df, str(tmp_path)).count() >= 5
