"""What belongs to a frame is worked out where the frame's boards were dealt, so its rows are not moved again."""

import re

import numpy as np

from pyspark.sql import functions as F

from tonewheel.functions.walk import bundles
from tonewheel.operators import dims, fit, lift
from tonewheel.plans import fitting, lifting


def moves(df) -> list[str]:
    """The kinds and first keys of the plan's exchanges other than the boards' deal and broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [m for m in re.findall(r"(?<!Broadcast)Exchange (\w+\(\w+)", plan) if m != "hashpartitioning(c_custkey"]


def test_black_edges_are_the_board_keys(spark):
    keys = dims.board_keys(dims.boards(spark)).where("black").orderBy("semitone").collect()
    for n, letter in dims.STANDARD_BOARDS:
        low, high = dims.black_edges(60 + dims.LETTER_SEMITONES[letter], n)
        mine = [k for k in keys if (k.white_keys, k.phase) == (n, letter)]
        assert low.tolist() == [k.x_from for k in mine] and high.tolist() == [k.x_to for k in mine]


def test_a_bundle_is_not_moved_and_a_long_one_not_held(spark, sf):
    tops = fit.on_template(fitting.peaks(spark, sf), lifting.fits(spark, sf)).select("frame_id", "cand", "channel", "x", F.lit(None).cast("array<double>").alias("info"))
    sizes = {(r.frame_id, r.cand): r["count"] for r in tops.groupBy("frame_id", "cand").count().collect()}
    most = sorted(sizes.values())[len(sizes) // 2]
    got = bundles(tops, "frame_id", fit.CAND, ["channel"], ["x"], most, lambda key, info, rows: [(*key, -1 if rows is None else len(rows))], "frame_id bigint, cand int, n int")
    assert moves(got) == moves(tops)
    assert {(r.frame_id, r.cand): r.n for r in got.collect()} == {k: n if n <= most else -1 for k, n in sizes.items()}


def test_lifts_in_one_place_are_those_of_packs(spark, sf, monkeypatch):
    peaks, fits = fitting.peaks(spark, sf).where("frame_id < 40").cache(), lifting.fits(spark, sf).where("frame_id < 40").cache()
    here = {r.frame_id: r.lift for r in lift.estimate_lift(peaks, fits).collect()}
    monkeypatch.setattr(lift, "LIFT_TOPS", 100)
    apart = {r.frame_id: r.lift for r in lift.estimate_lift(peaks, fits).collect()}
    assert len(here) == 40 and here.keys() == apart.keys()
    assert all(np.allclose(here[k], apart[k], atol=1e-9) for k in here)


def test_black_places_are_the_board_keys(spark):
    boards = dims.boards(spark)
    keys = dims.board_keys(boards).where("black").select("white_keys", "phase", (F.col("semitone") - F.col("white_ord")).alias("n"), "x_from")
    tried = boards.withColumn("n", F.explode(F.sequence(F.lit(-3), F.lit(60)))).select("white_keys", "phase", "n", dims.black_at(dims.black_start("phase"), "white_keys", "n").alias("at"))
    assert tried.where("at is not null").exceptAll(keys).isEmpty() and tried.where("at is not null").count() == keys.count() > 0


def test_reprojected_labels_are_neither_moved_nor_stored(spark, sf, monkeypatch):
    def none(df):
        raise AssertionError("stored")

    monkeypatch.setattr(lift, "cut", none)
    slots = lifting.view(spark, sf, "fx_drawn").select("frame_id", "channel", "ord", "x_px", "y_px").repartition(8, "frame_id")
    boards = lifting.view(spark, sf, "fx_boards").select("frame_id", "white_keys", "phase").repartition(8, "frame_id")
    lines = lift.reproject(slots, boards, 1)._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [n for n, line in enumerate(lines) if "ShuffledHashJoin" in line]
    assert len(joins) >= 2 and not any("Exchange" in line for line in lines[: joins[1]])


def test_a_pool_in_one_pass_is_its_three_parts_and_is_not_moved(spark, sf):
    peaks = fitting.prior_peaks(spark, sf)
    off = peaks.unionByName(peaks.withColumn("cand", F.lit(1)).withColumn("shift", F.lit(-1))).unionByName(peaks.withColumn("cand", F.lit(2)).withColumn("est", F.lit(None).cast("array<double>")))
    parts = fit.snap_corners(off).unionByName(fit.snap_gaps(off)).unionByName(fit.snap_blacks(off))
    once = fit.pool_rows(off)
    assert once.count() == parts.count() > 0 and once.exceptAll(parts).isEmpty()
    dealt = peaks.repartition(8, "frame_id")
    assert moves(fit.build_pool(dealt)) == moves(dealt)


def test_votes_are_not_moved_and_parts_agree(spark, sf, monkeypatch):
    pool = fit.build_pool(fitting.prior_peaks(spark, sf).where("frame_id < 8").repartition(8, "frame_id")).cache()
    here = {r.frame_id: (r.votes, r.homography) for r in fit.vote(pool).collect()}
    monkeypatch.setattr(fit, "PART", 64)
    apart = {r.frame_id: (r.votes, r.homography) for r in fit.vote(pool).collect()}
    assert here == apart and len(here) == 8


def test_prefilled_tops_meet_where_their_frame_is(spark, sf, monkeypatch):
    peaks, fits = fitting.peaks(spark, sf).where("frame_id < 30").repartition(8, "frame_id").cache(), lifting.fits(spark, sf).where("frame_id < 30").repartition(8, "frame_id").cache()
    here = lift.prefill(fits, peaks)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"(?<!Broadcast)Exchange .*ENSURE_REQUIREMENTS", plan)
    here = sorted(map(tuple, here.collect()), key=repr)
    monkeypatch.setattr(lift, "WIDE_KEYS", 40)
    assert here == sorted(map(tuple, lift.prefill(fits, peaks).collect()), key=repr) and len(here) > 5000


def test_outlines_of_a_batch_are_those_of_each_key(spark, sf):
    from tonewheel.functions import geometry as G

    fits = lifting.fits(spark, sf).where("frame_id < 20")
    made = lift.key_outlines(fits)
    bar = F.when(F.col("black"), lift.silhouette("top", "footprint")).otherwise(F.col("top"))
    each = lift.key_faces(fits).select("frame_id", "semitone", F.transform(bar, lambda p: G.bent(p, F.col("lens_k"), F.col("lens_aspect"))).alias("bar"))
    assert made.select("frame_id", "semitone", "bar").exceptAll(each).isEmpty() and made.count() == each.count() > 0
    # points are placed and bent in the batch, no function over an array is left
    assert "lambda" not in made.select("frame_id", "bar")._jdf.queryExecution().optimizedPlan().toString()


def test_a_lone_point_is_not_searched_for(spark):
    from tonewheel.operators import labels

    cols = "frame_id long, channel int, x_crop double, y_crop double, crop_width int, crop_height int"
    points = spark.createDataFrame([(1, 4, 20.5, 31.0, 768, 160), (2, 4, 20.5, 31.0, 768, 160), (2, 4, 22.5, 31.0, 768, 160)], cols)
    made = labels.heat_targets(labels._with_cells(points).select(*points.columns))
    cells = {(r.frame_id, r.i, r.j): r.value for r in made.collect()}
    one = {k[1:]: v for k, v in cells.items() if k[0] == 1}
    assert len(one) == 56 and all(cells[(2, *k)] >= v for k, v in one.items())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnull(_points" in plan.replace("isnull((_points", "isnull(_points")
