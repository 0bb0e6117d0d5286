"""Peaks are placed once a row, not inside a join's condition."""

import numpy as np
from pyspark.sql import functions as F

from tonewheel.operators import dims, fit

BOARD = "frame_id long, cand int, white_keys int, phase string, "


def joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_snaps_leave_the_joins_condition_alone(spark):
    est = [(1, 0, 36, "C", 0, [36.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    boards = spark.createDataFrame(est, BOARD + "shift int, est array<double>")
    rows = [(1, 4, 1, 5.1 / 36, 0.7), (1, 4, 2, 6.4 / 36, 0.7), (1, 9, 1, 35.0 / 36, 0.2), (1, 9, 2, 36.0 / 36, 0.2)]
    peaks = spark.createDataFrame(rows, "frame_id long, channel int, ord long, x double, y double")
    snapped = fit.snap_gaps(boards.join(peaks, "frame_id"))
    assert joins(snapped) and not any("FLOOR" in line for line in joins(snapped))
    assert sorted((r.channel, r.ord, r.src_x, r.src_y) for r in snapped.collect()) == [(4, 1, 5.0, 1.0), (9, 1, 35.0, 0.0)]


def test_refits_leave_the_joins_condition_alone(spark):
    pool = spark.createDataFrame([(1, 0, float(i % 3), float(i // 3), i % 3 * 2.0, i // 3 * 2.0) for i in range(9)], "frame_id long, cand int, src_x double, src_y double, dst_x double, dst_y double")
    seeds = spark.createDataFrame([(1, 0, 9, [2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0])], "frame_id long, cand int, votes long, homography array<double>")
    refit = fit.refine_votes(pool, seeds)
    assert joins(refit) and not any("SQRT" in line for line in joins(refit))
    assert np.allclose(refit.first()["homography"], seeds.first()["homography"], atol=1e-9)


def test_points_near_are_those_of_the_whole_board(spark):
    spots = spark.createDataFrame([(i, 45, "E", c, i * 0.173 - 1.0) for i in range(280) for c in (4, 5, 6, 9)], "id int, white_keys int, phase string, channel int, at double")
    got = dims.template_near(spots, F.col("at"), F.col("channel"), 0.3).select("id", "channel", "near_x", "near_y")
    board = dims.template_points(spots.select("white_keys", "phase").distinct()).select(F.col("channel").alias("kind"), "x", "y")
    want = spots.crossJoin(board).where((F.col("kind") == F.col("channel")) & (F.abs(F.col("x") - F.col("at")) < 0.3)).select("id", "channel", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 300
