"""Fill-in-the-middle by code points against a loop over regular expressions."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from framelake.llm import middles

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def looped(key, text, seed=42, rate=50, spm=80):
    text, units = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["", " ", "\n\n", " a", "a ", "a", "  a　b c \t", "\U0001f600 \U0001f600x\n", "<", "a <", "<S", "S> <P", "> <", "one <P> two", "<M>", "\x1c \x0b\x0c", "é " * 40, "w " * 50_000, "x" * 200_000]


@pytest.mark.parametrize("text", ODD)
def test_units_and_forms_are_the_loops(text):
    seen = set()
    for key in range(60):
        got = middles.cut(text, str(key), rate=100)
        assert got == looped(key, text, rate=100)
        seen.add(got[1])
    assert seen == ({"plain"} if not text or re.search("<[PSM]>", text) else {"psm", "spm"})


@pytest.mark.parametrize("name", ["docs", "clashing", "nothing"])
def test_rows(request, rows, name):
    df = request.getfixturevalue(name)
    out = middles.transform(df)
    found = out.select("row.*", "n", "form", "prefix_chars", "middle_chars", "output", middles.restored(F.col("output"), F.col("form")).alias("restored")).collect()
    assert out.columns == ["row", "n", "form", "prefix_chars", "middle_chars", "output"]
    if name == "nothing":
        assert not found
        return
    assert {tuple(r[-6:-1]) for r in found} == {looped(k, t) for k, t, *_ in rows}
    assert {(r.doc_id, r.text) for r in found} == {(k, t) for k, t, *_ in rows} and len(found) == len(rows)
    assert all(r.restored == (r.text or "") for r in found)


def test_odd_texts_come_back(spark):
    df = spark.createDataFrame([(k, t) for k in range(12) for t in ODD] + [(None, "a b c d"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    out = middles.transform(df, rate=100).select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", middles.restored(F.col("output"), F.col("form")).alias("restored")).collect()
    assert len(out) == 12 * len(ODD) + 4
    for r in out:
        assert tuple(r[2:7]) == looped(r.doc_id, r.text, rate=100) and r.restored == (r.text or "")
