"""The steps of a session: their geometry, and how their rows are dealt."""

import numpy as np
import pytest

from tonewheel.operators.solve import homographies
from tonewheel.plans import tracking
from tonewheel.streaming import filters, jobs


def test_tops_are_where_the_solved_homography_puts_them():
    draw = np.random.default_rng(3)
    for white_keys in (29, 52):
        quad = np.array([0.1, 0.3, 0.8, 0.25, 0.9, 0.6, 0.05, 0.55]) + draw.uniform(-0.04, 0.04, 8)
        lifts = draw.uniform(-0.05, 0.05, (2, 3))
        board = np.array([[(0, 0), (white_keys, 0), (white_keys, 1), (0, 1)]], dtype=float)
        h = homographies(board, quad.reshape(1, 4, 2))[0].reshape(3, 3)
        want = [h @ (white_keys / 2, filters.BLACK_DEPTH, 1) + lift for lift in lifts]
        tops, key = filters.middle_tops(quad.tolist(), lifts.tolist(), white_keys, 1280.0, 720.0)
        assert np.allclose(tops, [(u / s * 1280, v / s * 720) for u, v, s in want])
        p = quad.reshape(4, 2) * (1280, 720)
        assert key == pytest.approx((np.hypot(*(p[1] - p[0])) + np.hypot(*(p[2] - p[3]))) / 2 / white_keys)


def test_a_quad_without_area_keeps_its_lift():
    state = {}
    for i in range(3):
        fit = filters.smooth(state, {"quad": [0.1, 0.2] * 4, "lift": [0.0, -0.01, 0.0], "white_keys": 52}, i * 33.0, 1280.0, 720.0)
    assert fit["lift"] == pytest.approx([0.0, -0.01, 0.0]) and state["jumps"] == 0


def test_sessions_are_not_merged_into_few_tasks(spark, sf):
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (jobs.track(tracking.frames(spark, sf)), jobs.sessions(tracking.frames(spark, sf))):
        assert f", {shares}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
