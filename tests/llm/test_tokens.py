from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import blocks as B
from framelake.llm import bpe, lexicon, packing, records, separators

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def library(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'srevmdl1é½漢  　\u0085İΣ😀ab"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_ids_are_the_library_s(path, texts):
    data, offsets = B.buffers(pa.array(texts))
    ids, count = bpe.load(path).encode(data, offsets)
    ends = np.cumsum(count)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, count, strict=True)] == [library(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_code_point(path):
    """Assigned or not, between letters, after a space, a digit and an apostrophe, and doubled."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 65536):
        texts = [f"a{c}b {c}{c} 1{c}'s{c} e{c}" for c in map(chr, points[a : a + 65536])]
        ids, count = bpe.load(path).encode(*B.buffers(pa.array(texts, pa.large_string())))
        ends = np.cumsum(count)
        want = LIBRARY[path].encode_batch(texts, add_special_tokens=False)
        wrong = [hex(points[a + k]) for k, (e, c) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)) if ids[e - c : e].tolist() != want[k].ids]
        assert not wrong, (len(wrong), wrong[:20])


@pytest.mark.parametrize("path", sorted(LIBRARY))
def test_every_code_point_among_marks(path):
    """Before and after marks, and between two: whether a later mark composes across it is the library's to say. Of long blocks of one kind some."""
    alike = lambda c: 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0x17000 <= c < 0x19000 or c >= 0x20000  # noqa: E731  long blocks of one kind
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (not alike(c) or c % 61 == 0)]
    for a in range(0, len(points), 65536):
        texts = [f"e{c}\u0301 \u0323{c}o{c}\u0323\u0302 \u1100{c}\u11a8" for c in map(chr, points[a : a + 65536])]
        ids, count = bpe.load(path).encode(*B.buffers(pa.array(texts, pa.large_string())))
        ends = np.cumsum(count)
        want = LIBRARY[path].encode_batch(texts, add_special_tokens=False)
        wrong = [hex(points[a + k]) for k, (e, c) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)) if ids[e - c : e].tolist() != want[k].ids]
        assert not wrong, (len(wrong), wrong[:20])


def lexicon_file(path, data):
    path.write_bytes(data)
    return str(path)


def test_transducer_finds_its_words_and_no_others(tmp_path):
    rnd = random.Random(1)
    words = list({bytes(rnd.choices(b"abc", k=rnd.randint(1, 7))) for _ in range(300)} | {b"\xff\x00", b"a" * 48})
    ids = [[rnd.randrange(50000) for _ in range(rnd.randint(1, 4))] for _ in words]
    lex = lexicon.Lexicon(lexicon_file(tmp_path / "words.fsa", lexicon.compile_words(words, ids)))
    asked = words + [b"abcabcabca", b"", b"d", b"a" * 49, b"\xff"]
    data, offsets = B.buffers(pa.array(asked, pa.binary()))
    found = lex.find(data, offsets)
    for w, k in zip(asked, found, strict=True):
        assert (k >= 0) == (w in words)
        if k >= 0:
            assert lex.ids(np.array([k])).tolist() == ids[words.index(w)]
    assert len(lex.final) < sum(map(len, words))  # suffixes are shared


def test_no_words_compile_to_an_empty_transducer(tmp_path):
    lex = lexicon.Lexicon(lexicon_file(tmp_path / "none.fsa", lexicon.compile_words([], [])))
    assert lex.find(np.frombuffer(b"ab", np.uint8), np.array([0, 1, 2])).tolist() == [-1, -1]


def test_encode_and_decode(docs, rows, nothing, clashing):
    for df in (docs, clashing):
        found = {r.doc_id: r for r in lexicon.decode(lexicon.encode(df, BYTE), BYTE).collect()}
        assert len(found) == len(rows)
        for r in rows:
            assert np.frombuffer(found[r[0]].ids, "<u4").tolist() == library(BYTE, r[1])
            assert found[r[0]].decoded == LIBRARY[BYTE].decode(library(BYTE, r[1]), skip_special_tokens=False)
    assert lexicon.encode(nothing, BYTE).count() == 0


def test_ids_that_no_text_has(spark):
    ids = [[220, 102, 255], [447], [50256]]
    df = spark.createDataFrame([(np.array(x, "<u4").tobytes(),) for x in ids], "ids binary")
    assert [r.decoded for r in lexicon.decode(df, BYTE).collect()] == [LIBRARY[BYTE].decode(x, skip_special_tokens=False) for x in ids]


def test_checksums():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rnd = random.Random(2)
    parts = [b"123456789", b"", b"a", bytes(rnd.randbytes(256)), bytes(rnd.randbytes(257)), bytes(rnd.randbytes(1500))]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    assert records.crc32c(data, offsets).tolist() == [slow(p) for p in parts]
    assert records.crc32c(data, offsets)[0] == 0xE3069283


def test_records(docs, rows, nothing, clashing, spark):
    order = sorted(rows)
    want, start = [], 0
    for r in order:
        ids = [*library(WORD, r[1]), 1]
        want.append((r[0], start, ids))
        start += len(ids)
    for df in (docs, clashing):
        files = records.write(df, WORD)
        got = sorted((r.key, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in records.read(files).collect())
        assert got == want
    assert records.read(records.write(nothing, WORD)).count() == 0
    null = docs.withColumn("doc_id", F.when(F.col("doc_id") > 900, F.col("doc_id"))).unionByName(docs)
    got = records.read(records.write(null, WORD)).collect()
    assert len(got) == 2 * len(rows) and {r.start for r in got if r.key is None} and min(r.start for r in got if r.key is not None) > max(r.start for r in got if r.key is None)


def test_rows_of_one_key_are_cut_over_files(spark):
    """Half of all rows have no key; no file holds them all, and what is read back is in order."""
    df = spark.createDataFrame([(None if k % 2 else k, f"text {k} " * (k % 7)) for k in range(4000)], "doc_id long, text string").repartition(5)
    files = records.write(df, WORD)
    sizes = [r.records for r in files.collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1800
    got = records.read(files).orderBy("start").collect()
    keys = [r.key for r in got]
    assert keys[:2000] == [None] * 2000 and keys[2000:] == sorted(range(0, 4000, 2))
    assert [r.start for r in got] == np.cumsum([0, *(len(r["ids"]) // 4 for r in got)])[:-1].tolist()


def test_a_damaged_record_is_noticed():
    data, offsets = records.frames(pa.array([5, None]), np.array([1, 2, 3, 70]), np.array([1, 3]), 2)
    keys, ids, count = records.parse(data, offsets)
    assert (keys.to_pylist(), ids.tolist(), count.tolist()) == ([5, None], [1, 2, 3, 70], [1, 3])
    for k in range(len(data)):
        bad = data.copy()
        bad[k] ^= 4
        with pytest.raises(ValueError):
            records.parse(bad, offsets)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separators_on_any_block(spark, tmp_path, block):
    rnd = random.Random(block)
    files, want = [], set()
    for part in range(3):
        sizes = [rnd.randint(1, 9) for _ in range(rnd.randint(0, 8))]
        ids = [x for n in sizes for x in [*[5] * (n - 1), 9]] + ([5, 5] if part == 1 else [])
        np.array(ids, "<u2").tofile(f"{tmp_path}/{part}.bin")
        files.append((part, f"{tmp_path}/{part}.bin", len(ids)))
        want |= {(part, k, sum(sizes[:k]), n) for k, n in enumerate(sizes)}
        last = (part, len(sizes), sum(sizes), 2)
        if part == 1:
            extra = last
    got = {tuple(r) for r in separators.scan(spark, files, 9, block=block).collect()}
    assert got == want
    assert {tuple(r) for r in separators.scan(spark, files, 9, block=block, unended=True).collect()} == want | {extra}


def test_token_counts(docs, rows, nothing, clashing):
    """Also of texts that hold the separator's string."""
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    want = {r[0]: len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    for df in (docs, clashing):
        got = separators.token_counts(df, BYTE, 50256).collect()
        assert len(got) == len(rows) and {r.doc_id: r.n_tokens for r in got} == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
    assert separators.token_counts(nothing, BYTE, 50256).count() == 0


def test_ids_too_large_for_a_file_are_an_error(docs):
    with pytest.raises(Exception, match="bytes an id"):
        separators.token_counts(docs, BYTE, 70_000)
    assert separators.token_counts(docs, BYTE, 70_000, width=4).count() == docs.count()


def check_packing(found, capacity, rows=None):
    bins: dict[int, list] = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing(docs, rows, nothing, clashing, capacity):
    for df in (docs, clashing, docs.unionByName(docs)):
        copies = 2 if df.count() > len(rows) else 1
        found = packing.pack_documents(df, BYTE, 2, capacity).collect()
        total = 0
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r.doc_id, []).append(r)
        for doc_id, text, *_ in rows:
            ids = [*library(BYTE, text), 2]
            total += copies * len(ids)
            own = sorted(by[doc_id], key=lambda r: r.piece)
            assert sum(r.length for r in own) == copies * len(ids)
            for r in own:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
                assert r.length == capacity or r.piece == 0
        assert -(-total // capacity) <= check_packing(found, capacity) <= -(-total // capacity) * 1.1 + 1
    assert packing.pack_documents(nothing, BYTE, 2, capacity).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=6))
def test_reduction_never_costs_a_sequence(histogram):
    def best(items):  # the fewest sequences, by search
        items, most = sorted(items, reverse=True), len(items)

        def go(k, rooms):
            nonlocal most
            if len(rooms) >= most:
                return
            if k == len(items):
                most = len(rooms)
                return
            for r in {x for x in rooms if x >= items[k]}:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - items[k]])
            go(k + 1, [*rooms, 12 - items[k]])

        go(0, [])
        return most

    items = [s for s, n in histogram.items() for _ in range(n)][:9]
    counts = [0] * 13
    for s in items:
        counts[s] += 1
    fixed = packing.reduce(counts, 12)
    rest = [s for s in range(13) for _ in range(counts[s])]
    assert sorted([s for p, n in fixed for _ in range(n) for s in p] + rest) == sorted(items)
    assert all(sum(p) <= 12 for p, _ in fixed)
    assert sum(n for _, n in fixed) + (best(rest) if rest else 0) == (best(items) if items else 0)
