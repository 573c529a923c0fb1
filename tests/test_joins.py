"""Pixels and windows are never broadcast: their number is not foreseen."""

import re

import pytest

from rastermill.plans.catalog import QUERIES


def broadcast_keys(df) -> list[str]:
    """Keys of the broadcast joins that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)]


@pytest.mark.parametrize("name", ["bilinear_center", "centered_at_random", "ultimate_erosion", "adaptive_ultimate_erosion", "scored_windows", "box_iou_pairs", "graph_segments", "sliding_window_pipeline"])
def test_only_rows_of_whole_images_are_broadcast(spark, sf_dir, name):
    assert set(broadcast_keys(QUERIES[name](spark, sf_dir))) <= {"image_id", "image_id, segment", "r, c"}  # r, c: a kernel's table


@pytest.mark.parametrize("name", ["concave_points", "split_by_angle"])
def test_segments_are_not_worked_on_one_by_one(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
