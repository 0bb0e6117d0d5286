"""Planted boards are found again."""

import numpy as np
from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.operators import fit, labels, lift
from tonewheel.operators.solve import homographies
from tonewheel.plans import fitting, lifting


def test_square_and_solve_agree(spark):
    q = [(0.1, 0.3), (0.8, 0.25), (0.9, 0.6), (0.05, 0.55)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in q],)], "q array<struct<x:double,y:double>>")
    got = df.select(G.square_to("q", F.lit(52))).first()[0]
    board = np.array([[(0, 0), (52, 0), (52, 1), (0, 1)]], dtype=float)
    assert np.allclose(got, homographies(board, np.array([q]))[0])


def test_estimators_place_gaps_where_they_were_planted(spark, sf):
    peaks = fitting.peaks(spark, sf)
    est = fit.estimators(peaks, fitting.corner_plan(spark, sf).select("frame_id", "white_keys", "phase"))
    placed = peaks.where("channel = 4").join(est, "frame_id").withColumn("at", fit.estimate("est", "x", "y"))
    off = placed.select(F.abs(F.col("at") - F.col("ord")).alias("d")).agg(F.expr("percentile(d, 0.9)")).first()[0]
    assert off < 0.4


def test_counting_numbers_the_planted_gaps(spark, sf):
    rows = fitting.e3(spark, sf)
    right = rows.agg(F.avg((F.col("ord") == F.col("index")).cast("double")), F.count(F.lit(1))).first()
    assert right[1] > 0 and right[0] > 0.9


def test_a_large_pool_votes_like_a_small_one(spark, sf, monkeypatch):
    pool = fit.build_pool(fitting.prior_peaks(spark, sf).where("frame_id < 12"))
    small = {r["frame_id"]: (r["votes"], r["homography"]) for r in fit.vote(pool).collect()}
    monkeypatch.setattr(fit, "PART", 16)
    large = {r["frame_id"]: (r["votes"], r["homography"]) for r in fit.vote(pool).collect()}
    assert small.keys() == large.keys() and len(small) == 12
    for k in small:
        assert small[k][0] == large[k][0] and np.allclose(small[k][1], large[k][1])


def test_a_noiseless_board_gets_all_its_votes(spark):
    """A planted board among outliers: every true correspondence agrees, and the homography is the planted one."""
    board = np.array([[(0, 0), (52, 0), (52, 1), (0, 1)]], dtype=float)
    h = homographies(board, np.array([[(0.1, 0.3), (0.85, 0.2), (0.95, 0.6), (0.02, 0.55)]]))[0]
    true = [(float(x), y) for x in range(53) for y in (0.0, 1.0)]
    w = [h[6] * x + h[7] * y + 1 for x, y in true]
    rows = [(x, y, (h[0] * x + h[1] * y + h[2]) / k, (h[3] * x + h[4] * y + h[5]) / k) for (x, y), k in zip(true, w)]
    draw = np.random.default_rng(5)
    rows += [(float(draw.integers(53)), float(draw.integers(2)), *(3.0 + draw.random(2)).tolist()) for _ in range(40)]
    draw.shuffle(rows)
    line = [(float(i), 0.0, i / 60.0, 0.5) for i in range(20)]
    pool = [(1, 0, i, *map(float, r)) for i, r in enumerate(rows)] + [(2, 0, i, *r) for i, r in enumerate(line)] + [(3, 0, 0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(pool, "frame_id bigint, cand int, pos bigint, src_x double, src_y double, dst_x double, dst_y double")
    got = {r["frame_id"]: r for r in fit.vote(df).collect()}
    # a pool on one line has no sound sample, one under four rows no sample at all
    assert got.keys() == {1} and got[1]["votes"] == len(true) and np.allclose(got[1]["homography"], h, atol=1e-9)
    assert np.allclose(fit.refine_votes(df, fit.vote(df)).first()["homography"], h, atol=1e-6)


def test_fitting_finds_the_planted_homography(spark, sf):
    fits = fit.fit_frames(fitting.peaks(spark, sf), fitting.corner_plan(spark, sf))
    t = fitting.truth(spark, sf)
    far = fits.join(t.select("frame_id", F.col("homography").alias("want")), "frame_id")
    x, y = G.project("homography", F.col("white_keys") / 2.0, F.lit(0.5))
    u, v = G.project("want", F.col("white_keys") / 2.0, F.lit(0.5))
    key_px = F.col("key_px")
    rows = far.select((F.hypot((x - u) * F.col("width"), (y - v) * F.col("height")) / key_px).alias("d")).collect()
    assert len(rows) > 0.8 * t.count()
    assert sorted(r["d"] for r in rows)[int(len(rows) * 0.9)] < 0.3


def test_unlocked_frames_find_their_own_board(spark, sf):
    frames = fitting.frames(spark, sf).where("frame_id < 8")
    none = fitting.truth(spark, sf).where("1 = 0")
    plan = fit.candidate_plan(frames, none.select("frame_id", "white_keys", "phase"), none)
    assert plan.count() == 160
    best = fit.best_fit(fit.fit_frames(fitting.peaks(spark, sf).where("frame_id < 8"), plan))
    got = {r["frame_id"]: r["white_keys"] for r in best.collect()}
    want = {r["frame_id"]: r["white_keys"] for r in fitting.truth(spark, sf).where("frame_id < 8").collect()}
    assert got and all(want[f] == w for f, w in got.items())


def test_lift_depth_and_bend_are_read_back(spark, sf):
    peaks, fits = fitting.peaks(spark, sf), lifting.fits(spark, sf)
    got = {r["frame_id"]: r["lift"] for r in lift.estimate_lift(peaks, fits).collect()}
    want = {r["frame_id"]: r["lift1"] for r in fitting.truth(spark, sf).collect()}
    assert len(got) > 0.8 * len(want)
    # the planted lift is all in the second term, up to what perspective shifts into the others
    raised = [abs(l[1] - want[f]) * 720 for f, l in got.items()]
    assert sorted(raised)[len(raised) // 2] < 2.0
    depths = [r["black_depth"] for r in lift.black_depth(peaks, fits).collect()]
    assert abs(sorted(depths)[len(depths) // 2] - 0.62) < 0.02
    bends = [r["bend"] for r in lift.lens_bend(peaks, fits.withColumn("lens_k", F.lit(0.0))).collect()]
    assert abs(sorted(bends)[len(bends) // 2]) < 0.02


RING = "array<struct<x:double,y:double>>"


def rings(spark, *rows):
    return spark.createDataFrame([tuple([{"x": float(x), "y": float(y)} for x, y in ring] for ring in row) for row in rows], f"a {RING}, b {RING}")


def square(x, y, side):
    return [(x + dx * side, y + dy * side) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]


def test_silhouette_is_the_hull_from_the_tops_first_corner(spark):
    import random

    draw = random.Random(4)
    cases = [(square(0, 0, 1), square(0.5, 1, 1)), (square(0, 0, 1)[::-1], square(0.5, 1, 1)), (square(0, 0, 2), square(0.5, 0.5, 1)), (square(0, 0, 1), square(0, 0, 1)),
             ([(0, 0), (1, 0), (2, 0), (3, 0)], [(4, 0), (1, 0), (2, 0), (3, 0)])]
    cases += [([(draw.randrange(5), draw.randrange(5)) for _ in range(4)], [(draw.random() * 5, draw.random() * 5) for _ in range(4)]) for _ in range(60)]

    def cross(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def area(ring):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))

    got = [[(p["x"], p["y"]) for p in r[0]] for r in rings(spark, *cases).select(lift.silhouette("a", "b")).collect()]
    for (top, foot), hull in zip(cases, got):
        every = {*map(tuple, top), *map(tuple, foot)}
        assert set(hull) <= every and len(set(hull)) == len(hull) >= 2
        turns = [cross(a, b, c) for a, b, c in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2])] if len(hull) > 2 else []
        assert all(t > 0 for t in turns) or all(t < 0 for t in turns)
        way = 1 if area(hull) > 0 else -1
        assert len(hull) == 2 or all(way * cross(a, b, c) >= 0 for a, b in zip(hull, hull[1:] + hull[:1]) for c in every)
        assert area(hull) * area(top) >= 0
        assert hull[0] == min(hull, key=lambda p: (p[0] - top[0][0]) ** 2 + (p[1] - top[0][1]) ** 2)
    assert len(got[0]) == 6 and got[0][0] == (0, 0) and len(got[3]) == 4 and len(got[4]) == 2


def test_presence_cuts_the_quad_at_the_frame(spark):
    quads = [[(-50.0, 10.0), (50.0, 10.0), (50.0, 60.0), (-50.0, 60.0)], [(700.0, 0.0), (800.0, 0.0), (800.0, 9.0), (700.0, 9.0)],
             [(-100, -100), (900, -100), (900, 900), (-100, 900)], [(320, -240), (960, 240), (320, 720), (-320, 240)]]
    df = rings(spark, *[(q, q) for q in quads])
    got = [r[0] for r in df.select(labels.ring_area(labels.clipped("a", F.lit(640), F.lit(480)))).collect()]
    assert got == [2500.0, 0.0, 640.0 * 480.0, 640.0 * 480.0]
    frames = df.select(F.lit(1).alias("frame_id"), F.when(F.col("a")[0]["x"] != -50.0, F.col("a")).alias("quad"), F.lit(9).alias("keys"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    assert [r["presence"] for r in labels.presence(frames).collect()] == [0.0, 0.0, 1.0, 1.0]


def test_known_bends_are_recovered(spark):
    """A planted 52-key board seen through lenses of known bend."""
    board = np.array([[(0, 0), (52, 0), (52, 1), (0, 1)]], dtype=float)
    h = homographies(board, np.array([[(0.06, 0.35), (0.93, 0.3), (0.97, 0.72), (0.03, 0.68)]]))[0]
    aspect, peaks, fits = 16 / 9, [], []
    for frame, k in enumerate((0.0, 0.07, -0.06, 0.12)):
        reach = np.hypot(aspect, 1.0) / 2.0
        for channel, y in ((9, 0.0), (4, 1.0)):
            for x in range(1, 52):
                w = h[6] * x + h[7] * y + 1
                px, py = ((h[0] * x + h[1] * y + h[2]) / w - 0.5) * aspect / reach, ((h[3] * x + h[4] * y + h[5]) / w - 0.5) / reach
                s = np.hypot(px, py)
                scale = 1.0 if k == 0 else (1.0 - np.sqrt(1.0 - 4.0 * k * s * s)) / (2.0 * k * s * s)
                peaks.append((frame, channel, x, float(0.5 + px * scale * reach / aspect), float(0.5 + py * scale * reach)))
        fits.append((frame, 0, 52, "A", [float(v) for v in h], k, aspect))
    peaks = spark.createDataFrame(peaks, "frame_id bigint, channel int, ord bigint, x double, y double")
    fits = spark.createDataFrame(fits, "frame_id bigint, cand int, white_keys int, phase string, homography array<double>, lens_k double, lens_aspect double")
    got = {r["frame_id"]: r["bend"] for r in lift.lens_bend(peaks, fits).collect()}
    assert got.keys() == {0, 1, 2, 3}
    assert all(abs(got[f] - k) < 2e-3 for f, k in enumerate((0.0, 0.07, -0.06, 0.12))), got


def test_reproject_moves_gaps_one_key_along(spark, sf):
    out = lifting.e23(spark, sf)
    drawn = {(r["frame_id"], r["ord"]): r["x_px"] for r in lifting.view(spark, sf, "fx_drawn").where("channel = 4").collect()}
    steps = [r["x_px"] - drawn[r["frame_id"], r["ord"] + 1] for r in out.where("channel = 4 and x_px is not null").collect() if (r["frame_id"], r["ord"] + 1) in drawn]
    assert steps and max(map(abs, steps)) < 3.0


def test_votes_at_the_edge_are_counted_by_lengths(monkeypatch):
    from tonewheel.operators import solve

    # the board lies flat, so a quarter key is 0.25 wide; places just off, on and inside the edge
    flat = np.array([[1.0, 0, 0, 0, 1, 0, 0, 0, 1]])
    off = [0.25, np.nextafter(0.25, 0), np.nextafter(0.25, 1), 0.1, 0.4]
    points = np.array([(0.0, 0.0, d, 0.0) for d in off])
    looked = []
    monkeypatch.setattr(solve, "_near", lambda *a, _near=solve._near: looked.append(len(a[0])) or _near(*a))
    assert solve.agreeing(np.concatenate([flat, flat * np.nan]), points).tolist() == [2, 0] and looked == [3]
    assert solve.agreeing(flat, points[:0]).tolist() == [0]
