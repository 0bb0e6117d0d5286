"""Repeated label rows count apart."""

from tonewheel.operators import evaluate


def test_repeated_labels_count_apart(spark):
    rows = [(1, 0, 1, 10.0, 10.0, 20.0)] * 3 + [(1, 0, 2, 500.0, 500.0, 20.0)] * 2 + [(2, 0, 1, 1.0, 1.0, None)]
    labels = spark.createDataFrame(rows, "frame_id long, channel int, idx long, x double, y double, key_px double")
    peaks = spark.createDataFrame([(1, 0, 12.0, 10.0), (1, 0, 12.0, 10.0), (1, 0, 14.0, 10.0)], "frame_id long, channel int, x double, y double")
    got = evaluate.match_nearest(labels, peaks)
    assert sorted((r.idx, r.error_keys, r.matched) for r in got.where("frame_id = 1").collect()) == [(1, 0.1, True)] * 3 + [(2, None, False)] * 2
    assert got.count() == 6 and got.columns == [*labels.columns, "error_keys", "matched"]
    score = evaluate.group_scores(got.where("frame_id = 1")).first()
    assert score.labels == 5 and score.recall == 0.6
