"""A separator's string within a text must not end a document."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framelake.llm import blocks as B
from framelake.llm import bpe, separators

BYTE = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def plain_ids(text):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    return library.encode(text or "", add_special_tokens=False).ids


def test_special_strings_are_plain_text_if_asked_for():
    texts = [END, f"a {END} b", f"{END}{END}", f"x{END}\n", "no such", ""]
    ids, count = bpe.load(BYTE).encode(*B.buffers(pa.array(texts)), plain=True)
    ends = np.cumsum(count)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, count, strict=True)] == [plain_ids(t) for t in texts]


def test_counts_with_the_separator_in_texts(docs, rows, spark):
    got = separators.token_counts(docs, BYTE, 50256).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {r[0]: len(plain_ids(r[1])) + 1 for r in rows}
    assert len(got) == len(rows)
    texts = ["one", f"two {END} {END}", "three and four", END, None, "five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    at = 0
    for r in sorted(separators.token_counts(df, BYTE, 50256).collect(), key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(plain_ids(texts[r.doc_id])) + 1)
        at += r.n_tokens


def test_a_differing_number_is_an_error(spark, tmp_path):
    np.array([5, 9, 5, 9], "<u2").tofile(f"{tmp_path}/0.bin")
    files = [(0, f"{tmp_path}/0.bin", 4)]
    assert separators.scan(spark, files, 9, documents_of={0: 2}).count() == 2
    with pytest.raises(ValueError):
        separators.scan(spark, files, 9, documents_of={0: 1})
    with pytest.raises(Exception, match="separator"):  # an end that is an id of plain text
        separators.token_counts(spark.createDataFrame([(1, "one")], "doc_id long, text string"), BYTE, plain_ids("one")[0])
