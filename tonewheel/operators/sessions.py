"""Ordered state over sessions and notes, in batch form (section G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions.geometry import col
from tonewheel.functions.scans import SPAN, Running, affine, numbered, running

# Fixed values of the note effects.
FADE_MS, FULL_VELOCITY = 400, 127
NOTE_ON, NOTE_OFF = 0x90, 0x80
HOUR_MS = 3_600_000.0


def streaks(df: DataFrame, keys: list[str], order: str, condition) -> DataFrame:
    """How many rows in a row, up to this one, meet the condition, and where a run begins or ends.

    `order` is a dense index within the keys.
    """
    marked = df.withColumn("_hit", col(condition)).withColumn("_miss", F.when(~F.col("_hit"), F.col(order)))
    run = running(
        marked, keys, [order],
        [Running("_last_miss", "max", "_miss"), Running("_first", "min", order), Running("_before", "last", "_hit", False)],
    )
    since = F.col(order) - F.coalesce("_last_miss", F.col("_first") - 1)
    return run.withColumn("streak", since).withColumn("starts", F.col("_hit") & ~F.coalesce("_before", F.lit(False))).withColumn(
        "ends", ~F.col("_hit") & F.coalesce("_before", F.lit(False))
    ).drop("_hit", "_miss", "_last_miss", "_first", "_before")


def ema(df: DataFrame, keys: list[str], order: str, value: str, share: float, every: int = 1, span: int = SPAN) -> DataFrame:
    """V += share * (reading - v) over every `every`-th row; the first reading starts it. Any share from 0 to 1."""
    placed = numbered(df, keys, [order], "_pos").where((F.col("_pos") - 1) % every == 0)
    placed = placed.withColumn("_n", F.floor((F.col("_pos") - 1) / every))
    first = F.col("_n") == 0
    gain = F.when(first, 0.0).otherwise(1.0 - share)
    offset = F.when(first, F.col(value)).otherwise(F.col(value) * share)
    return affine(placed, keys, "_n", gain, offset, "ema", span).select(*df.columns, "ema")


def decode_notes(raw: DataFrame) -> DataFrame:
    """Note messages as on or off; other statuses and short messages are ignored."""
    status = F.col("b0").bitwiseAND(F.lit(0xF0))
    known = raw.where(F.col("b2").isNotNull() & F.col("pitch").isNotNull() & status.isin(NOTE_ON, NOTE_OFF))
    velocity = F.when(status == NOTE_ON, F.col("b2")).otherwise(F.lit(0))
    return known.select("device_id", "ord", "ts_ms", "pitch", velocity.cast("bigint").alias("velocity"), (velocity > 0).alias("is_on"))


def note_intervals(notes: DataFrame) -> DataFrame:
    """One row per note struck: when, how hard, when released, and when struck again.

    What ends a note is simply the next message of its pitch: an off releases it, an on strikes it
    anew; further offs find nothing open. The next message is found in hour-long chunks.
    """
    key = ["device_id", "pitch"]
    event = F.struct("ts_ms", "is_on")
    nexts = running(notes.withColumn("_e", event), key, ["ts_ms", "ord"], [Running("_next", "last", "_e", False)], HOUR_MS, reverse=True)
    return nexts.where("is_on").select(
        *key, "ord", F.col("ts_ms").alias("on_ms"), "velocity",
        F.when(~F.col("_next.is_on"), F.col("_next.ts_ms")).alias("released_ms"),
        F.when(F.col("_next.is_on"), F.col("_next.ts_ms")).alias("struck_again_ms"),
    )


def glow_at(times: DataFrame, intervals: DataFrame) -> DataFrame:
    """How lit a pitch is at each asked time: full while held, fading over 400 ms once released.

    The latest note struck at or before the time decides; `times` has device_id, pitch, t_ms, ask.
    """
    none = F.lit(None)
    note = F.struct("velocity", "released_ms")
    notes = intervals.select(
        "device_id", "pitch", F.col("on_ms").alias("_t"), F.lit(0).alias("_kind"), F.col("ord").alias("_ord"), note.alias("_note"), none.cast("bigint").alias("ask")
    )
    asks = times.select(
        "device_id", "pitch", F.col("t_ms").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_ord"),
        F.lit(None).cast("struct<velocity:bigint,released_ms:bigint>").alias("_note"), "ask",
    )
    met = running(notes.unionByName(asks), ["device_id", "pitch"], ["_t", "_kind", "_ord"], [Running("_latest", "last", "_note")], HOUR_MS)
    base = F.col("_latest.velocity") / F.lit(float(FULL_VELOCITY))
    since = F.col("_t") - F.col("_latest.released_ms")
    fading = base * (F.lit(1.0) - since / F.lit(float(FADE_MS)))
    level = (
        F.when(F.col("_latest").isNull(), 0.0)
        .when(F.coalesce(since < 0, F.lit(True)), base)
        .when(since >= FADE_MS, 0.0)
        .otherwise(fading)
    )
    return met.where("_kind = 1").select("device_id", "pitch", "ask", F.col("_t").alias("t_ms"), level.alias("level"))


def lit_keys(outlines: DataFrame, glow: DataFrame) -> DataFrame:
    """Outlines whose pitch, the board's lowest plus their semitone, glows."""
    pitched = outlines.withColumn("pitch", F.col("lowest_pitch") + F.col("semitone"))
    return pitched.join(glow.where("level > 0"), ["device_id", "pitch"])
