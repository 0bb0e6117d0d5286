"""Queries of section C: keyboard dimensions joined onto notes and frames."""

from pyspark.sql import functions as F

from tonewheel.operators import dims
from tonewheel.plans.registry import query, r6
from tonewheel.sources.fixtures import view

NOTE_CASE = (
    "CASE pc WHEN 0 THEN 'C' WHEN 1 THEN 'C#' WHEN 2 THEN 'D' WHEN 3 THEN 'D#' WHEN 4 THEN 'E' WHEN 5 THEN 'F' "
    "WHEN 6 THEN 'F#' WHEN 7 THEN 'G' WHEN 8 THEN 'G#' WHEN 9 THEN 'A' WHEN 10 THEN 'A#' ELSE 'B' END"
)


@query(
    "c1_pitches",
    ("fx_notes", "fx_pitches"),
    f"""SELECT n.device_id, n.ord, p.pitch, p.black,
 CASE WHEN p.black = 0 THEN p.white_index END AS white_index,
 round(p.unit_from, 6) AS unit_from, round(p.unit_from + p.unit_width, 6) AS unit_to,
 {NOTE_CASE} || CAST(CAST(floor(p.pitch / 12) AS BIGINT) - 1 AS VARCHAR) AS note
FROM (SELECT *, 20 + (ord * 7 + device_id) % 100 AS key FROM fx_notes) n JOIN fx_pitches p ON p.pitch = n.key""",
)
def c1(spark, sf):
    notes = view(spark, sf, "fx_notes").select(
        "device_id", "ord", (F.lit(20) + (F.col("ord") * 7 + F.col("device_id")) % 100).alias("pitch")
    )
    return dims.with_pitch_facts(notes).select(
        "device_id", "ord", "pitch", F.col("black").cast("int").alias("black"), "white_index",
        r6("unit_from").alias("unit_from"), r6("unit_to").alias("unit_to"), "note",
    )


@query(
    "c2_board_sizes",
    ("fx_pitches",),
    """SELECT s.keys, count(*) AS frames, max(s.whites) AS white_keys FROM orders o JOIN
 (SELECT b.keys, CAST(sum(1 - p.black) AS BIGINT) AS whites FROM (SELECT 49 AS keys, 36 AS lowest, 84 AS highest
  UNION ALL SELECT 61, 36, 96 UNION ALL SELECT 76, 28, 103 UNION ALL SELECT 88, 21, 108) b
  JOIN fx_pitches p ON p.pitch BETWEEN b.lowest AND b.highest GROUP BY b.keys) s
 ON s.keys = CASE o.o_orderkey % 4 WHEN 0 THEN 49 WHEN 1 THEN 61 WHEN 2 THEN 76 ELSE 88 END GROUP BY s.keys""",
)
def c2(spark, sf):
    k = F.col("o_orderkey") % 4
    pick = F.element_at(
        F.array(*[F.struct(F.lit(n).alias("keys"), F.lit(a).alias("lowest"), F.lit(b).alias("highest")) for n, a, b in dims.BOARD_SIZES]),
        (k + 1).cast("int"),
    )
    boards = spark.read.parquet(f"{sf}/orders.parquet").select(pick.alias("b")).select("b.*")
    return boards.select("keys", dims.white_count("lowest", "highest").alias("w")).groupBy("keys").agg(
        F.count(F.lit(1)).alias("frames"), F.max("w").alias("white_keys")
    )


@query(
    "c3_template_points",
    ("fx_boards", "fx_template"),
    """SELECT b.frame_id, t.channel, CAST(t.ord AS BIGINT) AS ord, round(t.x, 6) AS x, round(t.y, 6) AS y
FROM fx_boards b JOIN fx_template t ON b.white_keys = t.white_keys AND b.phase = t.phase""",
)
def c3(spark, sf):
    frames = view(spark, sf, "fx_boards").select("frame_id", "white_keys", "phase")
    return dims.template_points(frames).select("frame_id", "channel", "ord", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "c4_board_keys",
    ("fx_boards", "fx_board_keys"),
    """SELECT b.frame_id, CAST(k.semitone AS INT) AS semitone, k.black, round(k.x_from, 6) AS x_from, round(k.x_to, 6) AS x_to, round(k.depth, 6) AS depth
FROM fx_boards b JOIN fx_board_keys k ON b.white_keys = k.white_keys AND b.phase = k.phase""",
)
def c4(spark, sf):
    frames = view(spark, sf, "fx_boards").select("frame_id", "white_keys", "phase")
    return dims.board_keys(frames).select(
        "frame_id", "semitone", F.col("black").cast("int").alias("black"),
        r6("x_from").alias("x_from"), r6("x_to").alias("x_to"), r6("depth").alias("depth"),
    )


@query(
    "c5_lowest_pitch",
    (),
    """SELECT o_orderkey AS frame_id, CAST(first + 12 * floor((64.5e0 - reach / 2e0 - first) / 12e0 + 5e-1) AS BIGINT) AS lowest_pitch
FROM (SELECT o_orderkey, 20 + o_orderkey % 80 AS reach, CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5
 WHEN 4 THEN 7 WHEN 5 THEN 9 WHEN 6 THEN 11 END AS first FROM orders) b""",
)
def c5(spark, sf):
    letter = F.element_at(F.array(*[F.lit(c) for c in "CDEFGABX"]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("frame_id"),
        dims.lowest_pitch(letter, F.lit(20) + F.col("o_orderkey") % 80).alias("lowest_pitch"),
    )
