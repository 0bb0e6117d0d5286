"""Queries of the session state: G1-G3, G5, G7, G8, G12."""

from pyspark.sql import functions as F

from tonewheel.functions.scans import numbered
from tonewheel.operators import sessions
from tonewheel.plans.registry import query
from tonewheel.sources.fixtures import view
from tonewheel.streaming import jobs


def frames(spark, sf):
    """Orders as frames of 64 sessions; long stretches without a board, fits on two boards."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 64).alias("session_id"))
    f = numbered(o, ["session_id"], ["k"], "_n", 65536.0).withColumn("frame_index", (F.col("_n") - 1).cast("bigint"))
    i, k = F.col("frame_index"), F.col("k")
    away = (i + F.col("session_id") * 7) % 120 >= 100

    def one(keys, phase, explained, whole, left):
        x, y = left + (k % 5).cast("double") / 2000.0, F.lit(0.6) + (k % 3).cast("double") / 2000.0
        quad = F.array(x, y - 0.15, x + 0.7, y - 0.15, x + 0.7, y, x, y)
        lift = F.when(k % 4 != 0, F.array(F.lit(0.0), F.lit(-0.01) - (k % 7).cast("double") / 2000.0, F.lit(0.0)))
        return F.struct(
            F.lit(keys).alias("white_keys"), F.lit(phase).alias("phase"), F.lit(0).alias("shift"), whole.alias("whole"),
            explained.alias("explained"), quad.alias("quad"), lift.alias("lift"),
        )

    a = one(52, "A", F.lit(0.7) + (k % 9).cast("double") / 100.0, k % 6 != 0, F.lit(0.1))
    b = one(45, "E", F.when(i % 90 > 40, 0.95).otherwise(0.5) + (k % 4).cast("double") / 100.0, k % 8 != 0, F.lit(0.12))
    fits = F.when(k % 13 == 0, F.array().cast(f"ARRAY<{jobs.FIT}>")).otherwise(F.array(a, b))
    coarse = F.when(k % 10 != 0, F.array(*[F.lit(v) for v in (0.05, 0.43, 0.86, 0.43, 0.86, 0.61, 0.05, 0.61)]))
    return f.select(
        "session_id", (i * 33.0).alias("ts_ms"), "frame_index", F.lit(1280.0).alias("width"), F.lit(720.0).alias("height"),
        F.when(away, 0.2).otherwise(0.9).alias("presence"), fits.alias("fits"), coarse.alias("coarse"),
        F.when(k % 3 == 0, -0.05).alias("bend"), F.when(k % 3 == 1, 0.6).alias("depth"),
    )


def brief(df):
    return df.select("session_id", "frame_index", "mode", F.col("acquired").cast("int").alias("acquired"), "white_keys", F.round(F.get("quad", 0), 6).alias("x0"))


@query("g1_track")
def g1(spark, sf):
    return brief(jobs.track(frames(spark, sf)))


@query("g2_elect")
def g2(spark, sf):
    votes = frames(spark, sf).withColumn("_five", F.floor(F.col("frame_index") / 5)).select(
        (F.col("session_id") * 1000000 + F.col("_five")).alias("session_id"), "frame_index", "width", "height", F.posexplode("fits").alias("p", "f")
    ).select("session_id", (F.col("frame_index") * 32 + F.col("p")).alias("ord"), "width", "height", "f.*")
    return jobs.elect(votes.select("session_id", "ord", "white_keys", "phase", "explained", "quad", "width", "height"))


@query("g3_relock")
def g3(spark, sf):
    f = view(spark, sf, "fx_frames")
    k = F.col("frame_id")
    checks = f.select(
        F.col("clip_id").alias("session_id"), F.col("frame_index").cast("bigint").alias("ord"), F.lit(52).alias("lock_keys"), F.lit("A").alias("lock_phase"),
        F.lit(45).alias("alt_keys"), F.lit("E").alias("alt_phase"), F.when(k % 7 != 0, 0.9).alias("alt_explained"), F.when(k % 5 != 0, 0.7).otherwise(0.85).alias("locked_explained"),
    )
    return jobs.relock(checks)


@query("g5_one_euro")
def g5(spark, sf):
    notes = view(spark, sf, "fx_notes").select("device_id", "ts_ms", "ord", F.col("b2").cast("double").alias("x"), F.col("pitch").cast("double").alias("y"))
    out = jobs.one_euro(notes, "device_id", ["ts_ms", "ord"])
    return out.select("device_id", "ord", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("g7_smooth_fits")
def g7(spark, sf):
    fits = frames(spark, sf).where(F.size("fits") > 0).withColumn("f", F.get("fits", 0)).select(
        "session_id", "frame_index", "ts_ms", "width", "height", "f.white_keys", "f.quad", "f.lift"
    )
    out = jobs.smooth_fits(fits)
    return out.select("session_id", "frame_index", F.round(F.get("quad", 0), 6).alias("x0"), F.round(F.get("lift", 1), 6).alias("lift1"))


@query("g8_session")
def g8(spark, sf):
    return brief(jobs.sessions(frames(spark, sf)))


@query(
    "g12_live_notes",
    ("fx_notes",),
    """SELECT n.device_id, n.pitch, n.velocity, r.released_ms FROM lst n LEFT JOIN rel r ON r.device_id = n.device_id AND r.pitch = n.pitch WHERE r.released_ms IS NULL OR 1706000000000 - r.released_ms < 400""",
    """notes AS (SELECT device_id, ord, ts_ms, pitch, CASE WHEN b0 // 16 = 9 THEN b2 ELSE 0 END AS velocity FROM fx_notes WHERE b0 // 16 IN (8, 9) AND ts_ms <= 1706000000000),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, pitch ORDER BY ts_ms DESC, ord DESC) AS rn FROM notes WHERE velocity > 0) x WHERE rn = 1),
rel AS (SELECT n.device_id, n.pitch, min(n.ts_ms) AS released_ms FROM notes n JOIN lst l ON l.device_id = n.device_id AND l.pitch = n.pitch AND (n.ts_ms > l.ts_ms OR (n.ts_ms = l.ts_ms AND n.ord > l.ord)) WHERE n.velocity = 0 GROUP BY 1, 2)""",
)
def g12(spark, sf):
    notes = sessions.decode_notes(view(spark, sf, "fx_notes"))
    return jobs.live_notes(notes, 1706000000000)
