"""Tracker scripts, and a stream in several micro-batches against the batch form."""

import json
import shutil

import pytest

from tonewheel.operators import sessions
from tonewheel.plans import tracking
from tonewheel.sources.fixtures import view
from tonewheel.streaming import filters, jobs, tracker

QUAD = [0.1, 0.45, 0.8, 0.45, 0.8, 0.6, 0.1, 0.6]


def frame(i, presence=0.9, fits=((52, "A", 0.8, True),)):
    made = [
        {"white_keys": k, "phase": p, "shift": 0, "whole": w, "explained": e, "quad": QUAD, "lift": None} for k, p, e, w in fits
    ]
    return {"ts_ms": i * 33.0, "presence": presence, "width": 1280.0, "height": 720.0, "fits": made, "coarse": None, "bend": None, "depth": None}


def play(frames):
    state, held = None, []
    for f in frames:
        state, fit = tracker.track(state, f)
        held.append(fit)
    return state, held


def test_five_voting_frames_acquire_and_a_low_one_clears():
    assert [f is not None for f in play([frame(i) for i in range(5)])[1]] == [False] * 4 + [True]
    assert play([frame(0), frame(1), frame(2, 0.4), *[frame(i) for i in range(3, 7)]])[1][-1] is None


def test_frames_without_fits_neither_count_nor_clear():
    assert play([frame(0), frame(1, fits=()), *[frame(i) for i in range(2, 6)]])[1][-1] is not None


def test_fifteen_bad_frames_lose_the_board():
    good = [frame(i) for i in range(5)]
    held = play([*good, *[frame(i, fits=()) for i in range(5, 20)]])[1]
    assert held[18] is not None and held[19] is None


def test_another_board_for_three_checks_moves_the_lock():
    better = ((52, "A", 0.6, True), (45, "E", 0.9, True))
    state, _ = play([*[frame(i) for i in range(5)], *[frame(i, fits=better) for i in range(5, 49)]])
    assert state["lock"] == [52, "A"]
    state, _ = play([*[frame(i) for i in range(5)], *[frame(i, fits=better) for i in range(5, 50)]])
    assert state["lock"] == [45, "E"]


def test_one_euro_passes_the_first_and_holds_still():
    s = filters.one_euro(None, 5.0, 1.0, 0.0)
    assert (s["x"], s["y"]) == (5.0, 1.0)
    s = filters.one_euro(s, 5.0, 1.0, 33.0)
    assert (s["x"], s["y"]) == (5.0, 1.0)
    assert 5.0 < filters.one_euro(s, 6.0, 1.0, 66.0)["x"] < 6.0


def test_segments_change_nothing(spark, sf):
    frames = tracking.frames(spark, sf)
    apart = jobs.track(frames).select("session_id", "frame_index", "white_keys", "quad")
    whole = jobs.walk(frames.select(*jobs.FRAME_COLS), ["session_id"], ["frame_index"], jobs._visitor(jobs._track_row), jobs.TRACKED)
    assert jobs.with_segments(frames).agg({"segment": "max"}).first()[0] is not None
    key = lambda r: (r[0], r[1])
    assert sorted(apart.collect(), key=key) == sorted(whole.select("session_id", "frame_index", "white_keys", "quad").collect(), key=key)


def replay(spark, df, tmp_path, name, parts, run, seen=None):
    """Feeds the parts of a table to a streaming job one file, so one micro-batch, at a time."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    source = tmp_path / "in"
    source.mkdir()
    for n, part in enumerate(parts):
        out = tmp_path / f"p{n}"
        part.coalesce(1).write.parquet(str(out))
        shutil.copy(next(out.glob("*.parquet")), source / f"{n}.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    made, mode = run(stream), "update" if run not in (jobs.stream_track, jobs.stream_sessions) else "append"
    q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    if seen is not None:
        seen += [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in q.recentProgress]
    return spark.table(name)


@pytest.mark.parametrize("batch,stream", [(jobs.track, jobs.stream_track), (jobs.sessions, jobs.stream_sessions)])
def test_replay_equals_batch(spark, sf, tmp_path, batch, stream):
    frames = tracking.frames(spark, sf).where("session_id < 6").cache()
    cut = [frames.where(c) for c in ("frame_index < 9", "frame_index between 9 and 15", "frame_index > 15")]
    got = replay(spark, frames, tmp_path, f"out_{batch.__name__}", cut, stream)
    cols = ["session_id", "frame_index", "mode", "acquired", "white_keys", "quad", "lens_k"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, batch(frames).select(*cols).collect()))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def test_streamed_notes_end_as_the_batch_has_them(spark, sf, tmp_path, rocks):
    notes = sessions.decode_notes(view(spark, sf, "fx_notes")).where("device_id < 4").cache()
    cuts = notes.selectExpr("percentile(ts_ms, array(0.3, 0.6))").first()[0]
    parts = [notes.where(f"ts_ms <= {cuts[0]}"), notes.where(f"ts_ms > {cuts[0]} and ts_ms <= {cuts[1]}"), notes.where(f"ts_ms > {cuts[1]}")]
    got = replay(spark, notes, tmp_path, "live", parts, jobs.stream_live_notes).toPandas()
    now = notes.agg({"ts_ms": "max"}).first()[0]
    order = {"lit": 0, "released": 1, "faded": 2}
    last = got.assign(step=got["change"].map(order)).sort_values(["on_ms", "step"]).groupby(["device_id", "pitch"]).tail(1)
    fresh = last[(last["change"] != "faded") & (last["released_ms"].isna() | (now - last["released_ms"] < sessions.FADE_MS))]
    mine = {(r.device_id, r.pitch, r.velocity, None if r.released_ms != r.released_ms else r.released_ms) for r in fresh.itertuples()}
    assert mine == {(r["device_id"], r["pitch"], r["velocity"], r["released_ms"]) for r in jobs.live_notes(notes, now).collect()}


def test_faded_notes_leave_the_state_and_late_ones_are_counted(spark, tmp_path, rocks):
    schema = "device_id bigint, ord bigint, ts_ms bigint, pitch bigint, velocity bigint, is_on boolean"

    def made(*rows):
        return spark.createDataFrame(list(rows), schema)

    def off(order, ms, pitch):
        return (1, order, ms, pitch, 0, False)

    # pitch 62's release comes before its strike; 63 is struck again after its release; 64's release has no strike
    parts = [
        made((1, 1, 10_000, 60, 90, True), (1, 2, 10_050, 61, 80, True), off(3, 10_100, 60), off(5, 10_300, 62), off(9, 10_200, 64)),
        made((1, 4, 10_250, 62, 70, True), (1, 6, 10_400, 63, 60, True), off(7, 10_500, 63), (1, 8, 10_600, 63, 50, True), off(10, 10_320, 62)),
        made((2, 1, 20_000, 60, 40, True)),
        made((1, 11, 5_000, 61, 33, True), (2, 2, 20_100, 60, 41, True)),
        made((2, 3, 20_200, 61, 42, True)),
    ]
    seen = []

    def run(stream):
        return jobs.stream_live_notes(stream)

    got = replay(spark, parts[0], tmp_path, "faded", parts, run, seen)
    rows = {(r["device_id"], r["pitch"], r["on_ms"], r["released_ms"], r["change"]) for r in got.collect()}
    assert rows == {
        (1, 60, 10_000, 10_100, "released"), (1, 61, 10_050, None, "lit"), (1, 62, 10_250, 10_300, "released"), (1, 63, 10_600, None, "lit"),
        (2, 60, 20_000, None, "lit"), (1, 60, 10_000, 10_100, "faded"), (1, 62, 10_250, 10_300, "faded"), (2, 60, 20_100, None, "lit"), (2, 61, 20_200, None, "lit"),
    }
    states = [p["stateOperators"][0] for p in seen if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    # left at the end: 61 and 63 of the first device, 60 and 61 of the second
    assert max(s["numRowsTotal"] for s in states) > states[-1]["numRowsTotal"]
