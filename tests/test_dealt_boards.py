"""Boards and sidecar texts are short rows of a small file that grow into long work: every task takes a share of them."""

from tonewheel.operators import labels
from tonewheel.plans import ingest, labelling
from tonewheel.sources.fixtures import view


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_boards_go_to_all_tasks(spark, sf):
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("fx_keys", "fx_drawn", "fx_truth"):
        plan = plan_of(view(spark, sf, name))
        assert "Exchange hashpartitioning(c_custkey" in plan and f", {shares}), REPARTITION_BY_NUM" in plan


def test_validation_stays_behind_the_spread(spark, sf):
    plan = plan_of(ingest.good_frames(spark, sf))
    assert "from_json" not in plan and "customer" not in plan


def test_axes_are_summed_by_hash_and_meet_keys_unsorted(spark, sf):
    keys = labelling.keys(spark, sf)
    axes = labels.frame_axes(keys)
    assert "SortAggregate" not in plan_of(axes)
    white = labels.split_depth(keys, axes)
    assert "Sort [" not in plan_of(white) and "SortAggregate" not in plan_of(labels.board_corners(white))
    assert "SortMergeJoin" not in plan_of(labels.black_fronts(keys, axes))


def test_white_points_are_corners_and_gaps(spark, sf):
    keys = labelling.keys(spark, sf)
    white = labels.split_depth(keys, labels.frame_axes(keys))
    apart = labels.corner_points(labels.board_corners(white)).unionByName(labels.gaps(white))
    once = labels.white_points(white)
    assert once.count() == apart.count() and once.exceptAll(apart).isEmpty()


def test_each_outline_is_made_once(spark, sf):
    from tonewheel.plans import lifting

    plan = plan_of(lifting.e21(spark, sf))
    assert sum("ArrowEvalPython [" in line and "hulls" in line for line in plan.splitlines()) == 1


def test_cells_about_points_are_neither_moved_nor_kept(spark, sf):
    lines = [line.strip(" :+-*()0123456789") for line in plan_of(labelling.b20(spark, sf)).splitlines()]
    above = lines[: max(n for n, line in enumerate(lines) if line.startswith("Generate explode"))]
    assert not any(line.startswith(("Exchange", "HashAggregate", "SortAggregate", "Sort ")) for line in above)
