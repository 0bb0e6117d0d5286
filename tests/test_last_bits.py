"""Values next to a threshold fall to the side that the checking SQL puts them on."""

from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.operators import dims


def test_length_is_the_root_of_the_squares(spark):
    rows = [(k / 1e3, (k * 7 % 523) / 1e3) for k in range(1, 2000)]
    got = spark.createDataFrame(rows, "dx double, dy double").select("dx", "dy", G.length(F.col("dx"), F.col("dy")).alias("l")).collect()
    assert all(r.l == (r.dx * r.dx + r.dy * r.dy) ** 0.5 for r in got)


def test_a_black_key_ends_at_its_start_and_its_width(spark):
    keys = dims.board_keys(dims.boards(spark)).where("black").collect()
    assert keys and all(r.x_to == r.x_from + dims.BLACK_WIDTH for r in keys)


def test_a_fit_without_inliers_is_not_accepted(spark):
    from tonewheel.operators import fit

    rows = [(f, 0, p, x, y, x / 10 + (5.0 if f == 2 else 0.0), y / 10) for f in (1, 2) for p, (x, y) in enumerate([(0.0, 0.0), (5.0, 0.0), (5.0, 1.0), (0.0, 1.0), (2.0, 1.0)])]
    pool = spark.createDataFrame(rows, "frame_id long, cand int, pos long, src_x double, src_y double, dst_x double, dst_y double")
    h = [0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0]
    fits = spark.createDataFrame([(f, 0, 5, "C", 100, 100, h) for f in (1, 2)], "frame_id long, cand int, white_keys int, phase string, width int, height int, homography array<double>")
    plan = fit.accept_fits(pool, fits)
    got = plan.collect()
    assert [(r.frame_id, r.inliers, r.pool_len, r.reprojection_error) for r in got] == [(1, 5, 5, 0.0)]
    # counts and errors leave one aggregate, so the pool is read once
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_a_crop_side_is_summed_in_the_corners_order(spark):
    """A frame whose depth across its axis is zero but for rounding falls to the side that its SQL takes."""
    from tonewheel.operators import labels

    f = 1310080
    xs = [50 + f % 100, 50 + f % 100 + 150 + f * 3 % 700, 50 + f % 100 + 150 + f * 3 % 700 + f * 11 % 61 - 30, 50 + f % 100 + f * 7 % 51 - 25]
    y0 = 200 + f % 300
    ys = [y0, y0 + f * 5 % 41 - 20, y0 + (-1 if f % 19 == 0 else 1) * (f * 17 % 230), y0 + 5 + f * 13 % 190]
    xy = [v for x, y in zip(xs, ys) for v in (x / 1e3 * 640.0, y / 1e3 * 480.0)]
    quad = G.quad(*[F.lit(v) for v in xy])
    m = spark.range(1).select(labels.oriented_crop(quad).alias("m")).head().m
    px, py = xy[::2], xy[1::2]
    ax, ay = -px[0] + px[1] + px[2] - px[3], -py[0] + py[1] + py[2] - py[3]
    ex, ey = -px[0] - px[1] + px[2] + px[3], -py[0] - py[1] + py[2] + py[3]
    side = -1.0 if -ay * ex + ax * ey < 0 else 1.0
    assert m[4] * side * ax > 0


def test_corners_of_a_quad_next_to_degenerate_land_on_the_crop(spark):
    from tonewheel.operators import labels

    rows = []
    for f in (540460, 598271):
        x0, y0 = 50 + f % 100, 200 + f % 300
        xs = [x0, x0 + 150 + f * 3 % 700, x0 + 150 + f * 3 % 700 + f * 11 % 61 - 30, x0 + f * 7 % 51 - 25]
        ys = [y0, y0 + f * 5 % 41 - 20, y0 + (-1 if f % 19 == 0 else 1) * (f * 17 % 230), y0 + 5 + f * 13 % 190]
        rows.append([v for x, y in zip(xs, ys) for v in (x / 1e3 * 640.0, y / 1e3 * 480.0)])
    names = [f"{a}{i}" for i in range(4) for a in "xy"]
    quads = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).withColumn("quad", G.quad(*names))
    want = [(52.9655, 18.4615), (715.0345, 18.4615), (715.0345, 141.5385), (52.9655, 141.5385)]
    for r in quads.select(labels.rectified_points("quad", "quad").alias("c")).collect():
        assert [(round(p.x, 4), round(p.y, 4)) for p in r.c] == want


def test_a_point_by_the_edges_is_the_point_by_the_matrix(spark):
    from tonewheel.operators import labels

    xy = [100.0, 200.0, 500.0, 180.0, 560.0, 300.0, 60.0, 330.0]
    quad = G.quad(*[F.lit(v) for v in xy])
    points = spark.createDataFrame([(float(x), float(y)) for x in range(-50, 700, 83) for y in range(100, 420, 37)], "x double, y double")
    x, y = G.project(labels.rectified_crop(quad), "x", "y")
    for r in points.select(x.alias("mx"), y.alias("my"), F.get(labels.rectified_points(quad, F.array(G.point("x", "y"))), 0).alias("e")).collect():
        assert abs(r.mx - r.e.x) < 1e-6 * max(1.0, abs(r.mx)) and abs(r.my - r.e.y) < 1e-6 * max(1.0, abs(r.my))
