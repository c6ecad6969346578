from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[str | None]:
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "idiot,", "Été", "漢字", "don't", "x" * 90]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = say(30), say(60)
    near = base.split()
    near[30] = "changed"
    out = [None, "", " \n\t ", "one", "one two", base, base, base.upper(), " ".join(near), passage, say(10) + " " + passage, passage + "\n" + say(25) + "  " + passage, say(3000), "a " * 300, "y" * 5000, "<|endoftext|> and 's 'S it's  x　y", say(45), base + " tail"]
    return out + [say(rnd.randint(1, 40)) for _ in range(20)]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, ties, repeats and very long words and texts. doc_ids descend and have gaps."""
    found = [(1000 - 7 * k, t, "en", None if k % 5 == 0 else "s", None if t is None else len(t)) for k, t in enumerate(texts())]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """The same with columns whose names operators use themselves."""
    extra = "key long, row string, size string, shard string, slot string, k string, ids string, node string, spans string, score string, part string, `a b` string"
    return spark.createDataFrame([(*r, 1, *["z"] * 11) for r in rows], f"{SCHEMA}, {extra}")
