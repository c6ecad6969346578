"""Chunk files are written where their frames are made."""

from framelake.plans import sources

SF = "/root/testdata/sf0.001"


def test_texts_of_chunks_are_not_moved(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(sources, "write_lines", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()))
    sources.chunks_of(spark, SF)
    above = plans[0].split("Window", 1)[0]
    assert "StructsToJson" in above and "Exchange" not in above
