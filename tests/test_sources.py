"""Directories in, published tables out."""

import json

import pytest

from tonewheel.operators import datasets
from tonewheel.sources import sidecars, sinks

FACE = [{"x": 0.1, "y": 0.2}, {"x": 0.2, "y": 0.2}, {"x": 0.2, "y": 0.4}, {"x": 0.1, "y": 0.4}]


def write(directory, stem, data, image=True):
    (directory / f"{stem}.json").write_text(json.dumps(data) if not isinstance(data, str) else data)
    if image:
        (directory / f"{stem}.png").write_bytes(b"png")


def test_scan_needs_the_image(spark, tmp_path):
    for stem, image in (("b", True), ("a", True), ("c", False)):
        write(tmp_path, stem, {"imageWidth": 640, "imageHeight": 480, "corners": FACE, "keys": []}, image)
    for directory in (str(tmp_path), tmp_path.as_uri()):
        assert sorted(r["stem"] for r in sidecars.read_sidecars(spark, directory).collect()) == ["a", "b"]


def test_a_missing_directory_is_an_empty_table(spark, tmp_path):
    for directory in (str(tmp_path / "none"), (tmp_path / "none").as_uri()):
        got = sidecars.read_sidecars(spark, directory)
        assert got.columns == ["stem", "path", "text"] and got.count() == 0


def test_equal_stems_of_two_directories_stay_apart(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    write(one, "a", {"imageWidth": 1}, image=False)
    write(two, "a", {"imageWidth": 2}, image=True)
    write(two, "b", {"imageWidth": 3}, image=True)
    got = sidecars.read_sidecars(spark, [str(one), str(two), str(tmp_path / "none")]).collect()
    assert sorted((r["stem"], json.loads(r["text"])["imageWidth"]) for r in got) == [("a", 2), ("b", 3)]
    assert sidecars.read_sidecars(spark, str(one)).count() == 0


def test_scores_are_written_and_read_back(spark, tmp_path):
    rows = [("m", "d", v, n, f, g, 3, r) for v, n, f in (("all", 4, 0.25), ("low", 2, None)) for g, r in (("gap", 0.5), ("corner", None))]
    scores = spark.createDataFrame(rows, "model string, decoder string, view string, frames bigint, failure_rate double, grp string, labels bigint, recall double")
    sinks.write_scores(scores, str(tmp_path / "scores"))
    got = {r["entry"]: json.loads(r["json"]) for r in sinks.read_scores(spark, str(tmp_path / "scores")).collect()}
    gap, corner = {"labels": 3, "recall": 0.5}, {"labels": 3, "recall": None}
    assert got == {"m d": {"frames": 4, "failure_rate": 0.25, "groups": {"gap": gap, "corner": corner}},
                   "m d low": {"frames": 2, "failure_rate": None, "groups": {"gap": gap, "corner": corner}}}


def test_key_lines_are_written_in_order(spark, tmp_path):
    frames = spark.range(500).selectExpr("if(id % 5 = 0, 'b', 'a') AS clip_id", "499 - id AS frame", "CAST(NULL AS DOUBLE) AS key")
    sinks.write_keys_jsonl(frames, str(tmp_path / "keys"))
    for clip, want in (("a", [i for i in range(500) if (499 - i) % 5]), ("b", [i for i in range(500) if (499 - i) % 5 == 0])):
        files = sorted((tmp_path / "keys" / f"clip_id={clip}").glob("part-*"))
        lines = [json.loads(line) for file in files for line in file.read_text().splitlines()]
        assert [line["frame"] for line in lines] == want and lines[0]["key"] is None


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    broken = spark.range(100).selectExpr("'a' AS clip_id", "id AS frame", "raise_error('no') AS key")
    with pytest.raises(Exception, match="no"):
        sinks.write_keys_jsonl(broken, str(tmp_path / "keys"))
    assert not list((tmp_path / "keys").rglob("part-*")) and not (tmp_path / "keys" / "_SUCCESS").exists()


def test_bodies_are_delivered_once_also_after_a_failure(spark, tmp_path):
    sent, receipts = tmp_path / "sent", str(tmp_path / "receipts")
    sent.mkdir()
    batches = spark.createDataFrame([("r", i, f"body {i}") for i in range(20)], "run string, batch bigint, body string").repartition(4)

    def send(key, body, fail=False):
        if fail and key == "r/13":
            raise ValueError("refused")
        with open(sent / key.replace("/", "-"), "a") as file:
            file.write(body + "\n")

    with pytest.raises(Exception, match="refused"):
        sinks.deliver(batches, lambda key, body: send(key, body, True), receipts)
    assert sinks.deliver(batches, send, receipts) == 20
    assert sinks.deliver(batches, send, receipts) == 0
    assert {p.name: p.read_text().splitlines()[0] for p in sent.iterdir()} == {f"r-{i}": f"body {i}" for i in range(20)}


def test_validation_splits_and_says_why(spark, tmp_path):
    good = {"imageWidth": 640, "imageHeight": 480, "corners": FACE, "keys": [{"pitch": 60, "black": False, "top": FACE, "front": None}]}
    write(tmp_path, "good", good)
    write(tmp_path, "size", {**good, "imageWidth": 640.0})
    write(tmp_path, "flag", {**good, "cornerVisible": [True, False, True, 1]})
    write(tmp_path, "face", {**good, "keys": [{"pitch": 60, "black": False, "top": FACE[:3], "front": None}]})
    ok, bad = sidecars.validate(sidecars.read_sidecars(spark, str(tmp_path)))
    assert [r["stem"] for r in ok.collect()] == ["good"]
    assert {r["stem"]: r["reason"] for r in bad.collect()} == {
        "size": "invalid image dimensions", "flag": "cornerVisible must list 4 booleans", "face": "key top face must list exactly 4 corners",
    }


def test_a_version_is_published_once(spark, tmp_path):
    df = spark.createDataFrame([("a/x",), ("a/__pycache__/y",)], "path string")
    uri = sinks.publish(spark, {"still": df, "motion": None}, str(tmp_path), "set", "1", required=("still",))
    assert sinks.read_published(spark, uri, ("still",)).count() == 1
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"still": df}, str(tmp_path), "set", "1")
    with pytest.raises(FileNotFoundError):
        sinks.publish(spark, {"still": None}, str(tmp_path), "set", "2", required=("still",))


@pytest.mark.parametrize("n,held", [(0, 0), (1, 0), (2, 1), (50, 2), (150, 4), (250, 8)])
def test_split_holds_an_exact_share(spark, n, held):
    frames = spark.createDataFrame([(f"f{i}",) for i in range(n)], "stem string")
    out = datasets.split(frames, seed=3)
    assert out.count() == n and out.where("held").count() == held


def test_metric_batches_of_a_thousand(spark):
    metrics = spark.range(1500).selectExpr("'r' AS run", "id AS ord", "concat('a b', id) AS path", "1.0D AS value")
    tags = spark.createDataFrame([("r", "k", "v")], "run string, key string, value string")
    rows = datasets.metric_batches(metrics, tags, 7).orderBy("batch").collect()
    assert [r["items"] for r in rows] == [1000, 500, 1]
    assert json.loads(rows[0]["body"])["metrics"][0] == {"key": "a_b0", "value": 1.0, "timestamp": 7, "step": 0}
    assert json.loads(rows[2]["body"])["tags"] == [{"key": "k", "value": "v"}]
