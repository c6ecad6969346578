"""Every query that has SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from framelake import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(float(v), 8)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs_without_sql(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


def test_incoming_files_are_compressed(spark, sf_dir, monkeypatch):
    """What streams read is written once as text; it is the most that these queries write."""
    from framelake.plans import sources

    seen, own = [], sources.shared
    monkeypatch.setattr(sources, "shared", lambda s, name: seen.append(own(s, name)) or seen[-1])
    sources.i2(spark, sf_dir)
    incoming = next(p for p in seen if "/incoming" in p)
    files = [p for p, _, _ in sources.an.listed(spark, incoming) if "/part-" in p]
    assert files and all(p.endswith(".json.gz") for p in files)


def test_lines_are_counted_without_a_path_for_each_file(spark, sf_dir, monkeypatch):
    from framelake.plans import sources

    asked, own = [], sources.an.lines
    monkeypatch.setattr(sources.an, "lines", lambda s, paths: asked.extend(paths) or own(s, paths))
    assert sources.s2(spark, sf_dir).count() > 1
    assert len(asked) == 1
