"""What plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from framelake import registry


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_range_filters_reach_the_scan(spark, sf_dir):
    text = plan(registry.queries()["p7_half_open_range"](spark, sf_dir))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(o_orderkey,100\).*LessThan\(o_orderkey,1100\)", text)
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert "Exchange" not in text


@pytest.mark.parametrize("name", [n for n in sorted(registry.queries()) if n[0] in "jwm"])
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["j1_lookup", "j3_iou_matrix", "j7_containment", "w1_gap_islands", "w3_gap_fill", "w4_latest_wins", "a3_coverage", "a4_log_vote", "a6_track_quality", "g4_boxes_in_tiles", "m1_cap_by_size"])
def test_no_python_where_columns_can_say_it(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan(registry.queries()[name](spark, sf_dir)))


def test_tiles_need_no_exchange(spark, sf_dir):
    """Beyond the one that numbers the boxes."""
    text = plan(registry.queries()["g4_boxes_in_tiles"](spark, sf_dir))
    assert len(re.findall(r"\nExchange|\(\d+\) Exchange", text)) == 1


def test_overlaps_share_one_exchange_key(spark, sf_dir):
    """Boxes are numbered and joined by frame: the numbering's exchange serves the join."""
    text = plan(registry.queries()["j3_iou_matrix"](spark, sf_dir))
    assert set(re.findall(r"hashpartitioning\((\w+)#", text)) == {"l_orderkey"}


@pytest.mark.parametrize("name", ["a1_size_binned_recall", "a1_recall_at_thresholds"])
def test_recall_matches_once(spark, sf_dir, name):
    """One Python node and one scan, whatever the number of thresholds."""
    text = plan(registry.queries()[name](spark, sf_dir)).split("(1)")[0]
    assert len(re.findall("MapInPandas", text)) == 1 and len(re.findall("Scan parquet", text)) == 1


def test_track_quality_reads_its_table_once(spark, sf_dir):
    text = plan(registry.queries()["a6_track_quality"](spark, sf_dir)).split("\n\n(1)")[0]
    assert len(re.findall("Scan parquet", text)) == 1 and len(re.findall("Exchange", text)) <= 5
    assert "Join" not in text


@pytest.mark.parametrize("name", ["m1_cap_by_size", "m2_cap_by_track"])
def test_samples_are_limited_before_they_move(spark, sf_dir, name):
    """First rows of a cell or class are found below the exchange already."""
    text = plan(registry.queries()[name](spark, sf_dir)).split("\n\n(1)")[0]
    first, last = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert "Exchange" in text[first:last]


def test_containers_meet_in_cells(spark, sf_dir):
    text = plan(registry.queries()["j7_containment"](spark, sf_dir))
    assert re.search(r"(Left keys|Right keys).*cx.*cy|hashpartitioning\([^)]*cx", text)
