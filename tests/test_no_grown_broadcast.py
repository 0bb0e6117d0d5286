"""Exploded rows are not broadcast, however small the table they come from."""

from pyspark.sql import functions as F

from tonewheel.functions.lineage import grown
from tonewheel.operators import dims, evaluate

BOARD = "frame_id long, white_keys int, phase string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_template_points_are_merged_not_broadcast(spark):
    boards = spark.createDataFrame([(1, 36, "C")], BOARD)
    points = dims.template_points(boards).select("frame_id", "channel", F.col("ord").alias("idx"), "x")
    labels = spark.createDataFrame([(1, 4, 1, 2.0)], "frame_id long, channel int, idx long, y double")
    met = labels.join(points, ["frame_id", "channel", "idx"])
    assert "BroadcastHashJoin" not in plan(met) and met.count() == 1
    keys = spark.createDataFrame([(1,)], "frame_id long").join(dims.board_keys(boards).groupBy("frame_id").count(), "frame_id", "left")
    assert "BroadcastHashJoin" not in plan(keys) and keys.first()["count"] == 61


def test_any_exploded_side(spark):
    few = spark.range(3).select("id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("n"))
    assert "BroadcastHashJoin" in plan(few.join(spark.range(3), "id"))
    assert "BroadcastHashJoin" not in plan(grown(few).select("id", "n").join(spark.range(3), "id"))


def test_back_edge_rounds_read_stored_distances(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    rows = spark.createDataFrame([("a", float(k)) for k in range(50)], "case_color string, raw double")
    rows = rows.select("case_color", F.udf(seen, "double")("raw").alias("ahead_px"))
    report = {r.case_color: r.backs for r in evaluate.back_edge_report(rows).collect()}
    assert report == {"a": 50, "all": 50} and calls.value <= 50


def test_prefilled_tops_reach_few_squares(spark):
    from tonewheel.operators import lift

    h = [0.02, 0.0, 0.1, 0.0, 0.1, 0.3, 0.0, 0.0, 1.0]
    fits = spark.createDataFrame([(1, 0, 36, "C", 1000, 1000, h, [0.0, 0.0, 0.0])], BOARD.replace("white", "cand int, white") + ", width int, height int, homography array<double>, lift array<double>")
    bottoms = dims.template_points(fits).where("channel = 5").select("ord", (F.col("x") * 20 + 100).alias("px"), (F.col("y") * 100 + 300).alias("py")).collect()
    # one detected top a little under a key away from each bottom, towards every side in turn
    moved = [(1, 7, r.ord, (r.px + dx) / 1000, (r.py + dy) / 1000) for r in bottoms for dx, dy in [((-19.9, 0), (0, 19.9), (0, -19.9), (19.9, 0))[r.ord % 4]]]
    peaks = spark.createDataFrame(moved, "frame_id long, channel int, ord long, x double, y double")
    got = {r.ord: (round(r.x_px, 6), round(r.y_px, 6)) for r in lift.prefill(fits, peaks).where("channel = 7 and x_px is not null").collect()}
    near = {r.ord: min((((p[3] * 1000 - r.px) ** 2 + (p[4] * 1000 - r.py) ** 2), -p[2], round(p[3] * 1000, 6), round(p[4] * 1000, 6)) for p in moved) for r in bottoms}
    assert got == {k: v[2:] for k, v in near.items() if v[0] <= 400} and len(got) == len(bottoms)
