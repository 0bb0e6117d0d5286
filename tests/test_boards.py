"""Snapping on boards beside the standard ones."""

from pyspark.sql import functions as F

from tonewheel.operators import dims, fit, lift


def test_boards_beside_the_standard_ones(spark):
    boards = spark.createDataFrame([(1, 29, "C"), (2, 45, "E"), (3, 40, "F"), (4, 22, "B")], "frame_id long, white_keys int, phase string")
    points = dims.template_points(boards).where("channel in (4, 5, 6, 9)")
    one = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    fits = boards.select("frame_id", F.lit(0).alias("cand"), "white_keys", "phase", one.alias("homography"), F.lit(0.0).alias("lens_k"), F.lit(1.0).alias("lens_aspect"))
    peaks = points.select("frame_id", "channel", "ord", (F.col("x") + 0.1).alias("x"), "y")
    snapped = fit.snap_blacks(lift.placed_by_fit(peaks, fits.withColumn("homography", one)))
    want = {(r.frame_id, r.channel, r.ord): round(r.x, 9) for r in points.where("channel in (5, 6)").collect()}
    assert {(r.frame_id, r.channel, r.ord): round(r.src_x, 9) for r in snapped.collect()} == want
    assert lift.lens_matches(peaks, fits).groupBy("frame_id").count().orderBy("frame_id").collect() == points.groupBy("frame_id").count().orderBy("frame_id").collect()
    tops = peaks.where("channel = 5").withColumn("channel", F.lit(7))
    near = lift.lift_candidates(tops, fits)
    every = tops.alias("t").join(points.where("channel = 5").alias("p"), "frame_id").where("abs(t.x - p.x) < 1.5")
    assert near.count() == every.count() and near.select("frame_id").distinct().count() == 4
    lost = peaks.where("channel = 5").withColumn("x", F.expr("explode(array(double('inf'), double('-inf'), double('nan'), null, 1e300))"))
    assert dims.template_near(lost.join(boards, "frame_id"), F.col("x"), F.col("channel"), 0.3).count() == 0
