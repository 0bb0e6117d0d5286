"""The session steps as batch and streaming jobs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tonewheel.functions.scans import Running, running
from tonewheel.functions.walk import walk
from tonewheel.operators.sessions import FADE_MS, streaks
from tonewheel.streaming import filters, tracker

FIT = "STRUCT<white_keys INT, phase STRING, shift INT, whole BOOLEAN, explained DOUBLE, quad ARRAY<DOUBLE>, lift ARRAY<DOUBLE>>"
FRAME = (
    "session_id BIGINT, ts_ms DOUBLE, frame_index BIGINT, width DOUBLE, height DOUBLE, presence DOUBLE, "
    f"fits ARRAY<{FIT}>, coarse ARRAY<DOUBLE>, bend DOUBLE, depth DOUBLE"
)
TRACKED = "session_id bigint, frame_index bigint, ts_ms double, mode string, acquired boolean, white_keys int, phase string, explained double, quad array<double>, lift array<double>, lens_k double"
FRAME_COLS = ["session_id", "ts_ms", "frame_index", "width", "height", "presence", "fits", "coarse", "bend", "depth"]


def _plain(v):
    """Arrow's arrays and NaNs as lists and None."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return None if isinstance(v, float) and v != v else v


def _report(key, row, mode, fit, acquired, k):
    f = fit or {}
    return (
        key, int(row["frame_index"]), row["ts_ms"], mode, acquired, f.get("white_keys"), f.get("phase"), f.get("explained"), f.get("quad"), f.get("lift"), k
    )


def _track_row(state, key, row):
    was = state is not None and state["lock"] is not None
    state, fit = tracker.track(state, row)
    return state, _report(key, row, "track" if was else "search", fit, fit is not None and not was, 0.0)


def _session_row(state, key, row):
    state, out = tracker.session(state, row)
    return state, _report(key, row, out["mode"], out["fit"], out["acquired"], out["k"])


def _visitor(step: Callable):
    def visit(state, key, rows):
        made = []
        for row in rows:
            state, out = step(state, int(key[0]), _plain(row))
            made.append(out)
        return state, made

    return visit


def with_segments(frames: DataFrame, least: int = tracker.LOST_FRAMES) -> DataFrame:
    """Numbers the stretches of a session between runs of at least `least` frames without a board.

    Such a run always ends with nothing held and no votes, whatever came before, so stretches can be
    tracked apart and a long session need not stay on one task.
    """
    low = streaks(frames, ["session_id"], "frame_index", F.col("presence") < tracker.PRESENCE)
    # the frame that completes such a run closes its stretch
    closes = (F.col("streak") == least).cast("int")
    marked = low.drop("starts", "ends").withColumn("_closes", closes)
    counted = running(marked, ["session_id"], ["frame_index"], [Running("segment", "sum", "_closes", False)])
    return counted.drop("_closes", "streak")


def track(frames: DataFrame) -> DataFrame:
    """The fit held at every frame of every session; `frame_index` is dense in a session."""
    cut = with_segments(frames.select(*FRAME_COLS))
    return walk(cut, ["session_id", "segment"], ["frame_index"], _visitor(_track_row), TRACKED)


def sessions(frames: DataFrame) -> DataFrame:
    """The whole search-then-track loop, mode by mode. The lens outlives a lost board, so a
    session is one recurrence; its rows stream past the state."""
    return walk(frames.select(*FRAME_COLS), ["session_id"], ["frame_index"], _visitor(_session_row), TRACKED)


def stream(frames: DataFrame, step: Callable, order: str = "frame_index") -> DataFrame:
    """A session step over a streaming table of frames; state is kept per session.

    Rows of a micro-batch are put in order; a row older than the last one seen is dropped.
    """
    def update(key, batches, state):
        import pandas as pd

        held, last = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, -1)
        rows = sorted((_plain(r) for pdf in batches for r in pdf.to_dict("records")), key=lambda r: r[order])
        out = []
        for row in rows:
            if row[order] <= last:
                continue
            last = int(row[order])
            held, made = step(held, int(key[0]), row)
            out.append(made)
        state.update((json.dumps(held), last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")])

    grouped = frames.select(*FRAME_COLS).groupBy("session_id")
    return grouped.applyInPandasWithState(update, TRACKED, "held string, last bigint", "append", "NoTimeout")


def stream_track(frames: DataFrame) -> DataFrame:
    return stream(frames, _track_row)


def stream_sessions(frames: DataFrame) -> DataFrame:
    return stream(frames, _session_row)


def elect(votes: DataFrame) -> DataFrame:
    """The fit each session's votes agree on.

    `votes` has session_id, ord, white_keys, phase, explained, quad, width, height: five frames' fits.
    """
    def visit(state, key, rows):
        return (state or []) + [_plain(r) for r in rows], []

    def finish(state, key):
        won = tracker.elect(state, state[0]["width"], state[0]["height"])
        return [(int(key[0]), int(won["ord"]), won["white_keys"], won["phase"], won["explained"])]

    return walk(votes, ["session_id"], ["ord"], visit, "session_id bigint, ord bigint, white_keys int, phase string, explained double", finish)


def relock(checks: DataFrame) -> DataFrame:
    """The lock after each contrary check.

    `checks` has session_id, ord, lock_keys, lock_phase (the first lock), alt_keys, alt_phase,
    alt_explained (NULL for none), locked_explained (NULL for none).
    """
    def visit(state, key, rows):
        made = []
        for r in map(_plain, rows):
            state = state or {"lock": [r["lock_keys"], r["lock_phase"]], "streak": 0, "candidate": None}
            alt = None if r["alt_explained"] is None else {"white_keys": r["alt_keys"], "phase": r["alt_phase"], "explained": r["alt_explained"]}
            locked = None if r["locked_explained"] is None else {"explained": r["locked_explained"]}
            tracker.register_contrary(state, alt, locked)
            made.append((int(key[0]), int(r["ord"]), int(state["lock"][0]), state["lock"][1], state["streak"]))
        return state, made

    return walk(checks, ["session_id"], ["ord"], visit, "session_id bigint, ord bigint, lock_keys int, lock_phase string, streak int")


def one_euro(df: DataFrame, key: str, order: list[str], config=filters.CORNER_FILTER) -> DataFrame:
    """X and y of each key filtered along ts_ms; a true recurrence, streamed in order."""
    def visit(state, k, rows):
        made = []
        for r in rows:
            state = filters.one_euro(state, r["x"], r["y"], r["ts_ms"], config)
            made.append((k[0], *[r[o] for o in order], state["x"], state["y"]))
        return state, made

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (key, *order)) + ", x double, y double"
    return walk(df.select(key, *order, "x", "y", *([] if "ts_ms" in order else ["ts_ms"])), [key], order, visit, schema)


def smooth_fits(fits: DataFrame) -> DataFrame:
    """Every session's fits with corners and lift filtered along time."""
    def visit(state, key, rows):
        state, made = state or {}, []
        for r in map(_plain, rows):
            out = filters.smooth(state, r, r["ts_ms"], r["width"], r["height"])
            made.append((int(key[0]), int(r["frame_index"]), out["quad"], out["lift"]))
        return state, made

    return walk(fits, ["session_id"], ["frame_index"], visit, "session_id bigint, frame_index bigint, quad array<double>, lift array<double>")


def live_notes(notes: DataFrame, now) -> DataFrame:
    """G12, batch: the notes still held or fading at `now` per device, the rest pruned.

    Each pitch keeps its last strike and whether it was released since: one aggregate, no order kept.
    """
    struck = F.max(F.when(F.col("is_on"), F.struct("ts_ms", "ord", "velocity")))
    last = notes.where(F.col("ts_ms") <= now).groupBy("device_id", "pitch").agg(struck.alias("on"))
    met = notes.where((F.col("ts_ms") <= now) & ~F.col("is_on")).join(last.where("on is not null"), ["device_id", "pitch"])
    after = F.struct("ts_ms", "ord") > F.struct(F.col("on.ts_ms"), F.col("on.ord"))
    released = met.where(after).groupBy("device_id", "pitch").agg(F.min("ts_ms").alias("released_ms"))
    live = last.where("on is not null").join(released, ["device_id", "pitch"], "left")
    fresh = F.col("released_ms").isNull() | (F.lit(now) - F.col("released_ms") < FADE_MS)
    return live.where(fresh).select("device_id", "pitch", F.col("on.velocity").alias("velocity"), "released_ms")


NOTE_CHANGES = "device_id bigint, pitch bigint, on_ms bigint, velocity bigint, released_ms bigint, change string"


class NotePruner(StatefulProcessor):
    """One pitch of one device: its last strike and the releases after it, whatever order they came in.

    Releases without a strike are kept until the watermark passes them, since an earlier strike may still come. A timer
    400 ms after the release takes the note out of the state.
    """

    def init(self, handle):
        self.handle = handle
        self.note = handle.getValueState("note", "on_ms bigint, on_ord bigint, velocity bigint, off_ms array<bigint>, off_ord array<bigint>")

    def _held(self):
        if not self.note.exists():
            return None, []
        on_ms, on_ord, velocity, off_ms, off_ord = self.note.get()
        return (None if on_ms is None else (on_ms, on_ord, velocity)), list(zip(off_ms, off_ord))

    def _settle(self, on, offs, watermark):
        """Stores what can still matter, with the timer at which it no longer does."""
        offs = sorted(o for o in set(offs) if (o > on[:2] if on else o[0] > watermark))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        released = offs[0][0] if on and offs else None
        ends = offs[-1][0] + 1 if offs and not on else None if released is None else released + FADE_MS
        if on is None and not offs:
            self.note.clear()
        else:
            self.note.update((*(on or (None, None, None)), [m for m, _ in offs], [o for _, o in offs]))
            if ends is not None:
                self.handle.registerTimer(ends)
        return released

    @staticmethod
    def _change(key, on, released, change):
        import pandas as pd

        frame = pd.DataFrame([(key[0], key[1], on[0], on[2], released, change)], columns=[c.split()[0] for c in NOTE_CHANGES.split(", ")])
        return frame.astype({"released_ms": "Int64"})

    def handleInputRows(self, key, rows, timerValues):
        before, offs = self._held()
        on = before
        was = min((o for o in offs if on and o > on[:2]), default=None)
        for pdf in rows:
            for ms, order, velocity, is_on in zip(*(pdf[c].tolist() for c in ("ts_ms", "ord", "velocity", "is_on"))):
                if not is_on:
                    offs.append((ms, order))
                elif on is None or (ms, order) > on[:2]:
                    on = (ms, order, velocity)
        released = self._settle(on, offs, timerValues.getCurrentWatermarkInMs())
        if on is not None and (on != before or released != (was and was[0])):
            yield self._change(key, on, released, "lit" if released is None else "released")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        on, offs = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        released = min(offs)[0] if on and offs else None
        if released is not None and released + FADE_MS <= watermark:
            self._settle(None, [], watermark)
            yield self._change(key, on, released, "faded")
        else:
            self._settle(on, offs, watermark)

    def close(self):
        pass


def stream_live_notes(notes: DataFrame, delay: str = "1 second") -> DataFrame:
    """G12, stream: each change of a note that is struck, released, or faded and then forgotten.

    State is one value for each pitch of a device that sounds; it leaves once the watermark, `delay` behind the latest
    message, is 400 ms past the release. Messages older than the watermark are left out and counted by the query's progress
    (numRowsDroppedByWatermark). Needs the RocksDB state store:
    spark.sql.streaming.stateStore.providerClass =
    org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
    """
    rows = notes.select("device_id", "pitch", "ord", "ts_ms", "velocity", "is_on", F.timestamp_millis("ts_ms").alias("ts"))
    return rows.withWatermark("ts", delay).groupBy("device_id", "pitch").transformWithStateInPandas(
        NotePruner(), outputStructType=NOTE_CHANGES, outputMode="Update", timeMode="EventTime"
    )
