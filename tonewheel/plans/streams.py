"""Queries of section G, F15-F20 and H."""

from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.operators import datasets, motion, sessions
from tonewheel.plans.registry import query, r6
from tonewheel.sources import sinks
from tonewheel.sources.fixtures import view


@query(
    "f15_rolling_latency",
    (),
    """SELECT event_id, round(avg(value) OVER w, 10) AS mean_ms, count(value) OVER w AS held FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)""",
)
def f15(spark, sf):
    lines = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", "value")
    return motion.rolling_latency(lines, ["event_type"], ["event_id"], "value").select("event_id", F.round("mean_ms", 10).alias("mean_ms"), "held")


OUTLINES = """
ol AS (SELECT f.clip_id, f.frame_index, f.frame_id, k.semitone, c.c, CAST(100 * k.semitone AS DOUBLE) + CASE WHEN c.c IN (1, 2) THEN 21e0 ELSE 0e0 END + CAST(f.frame_id % 5 AS DOUBLE) / 2e0 AS x,
 5e1 + CASE WHEN c.c >= 2 THEN 83e0 ELSE 0e0 END + CAST(f.frame_id % 3 AS DOUBLE) * 4e-1 + CASE WHEN c.c = 2 THEN CAST(f.frame_id % 7 AS DOUBLE) ELSE 0e0 END AS y
 FROM fx_frames f CROSS JOIN (SELECT unnest([0, 1]) AS semitone) k CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c) c),
ed AS (SELECT a.*, b.x AS qx, b.y AS qy, sqrt((b.x - a.x)**2 + (b.y - a.y)**2) AS l FROM ol a JOIN ol b ON a.frame_id = b.frame_id AND a.semitone = b.semitone AND b.c = (a.c + 1) % 4),
sh AS (SELECT *, 1e0 + 36e0 * l / sum(l) OVER (PARTITION BY frame_id, semitone) AS s FROM ed),
rk AS (SELECT *, floor(s) AS n0, row_number() OVER (PARTITION BY frame_id, semitone ORDER BY s - floor(s) DESC, c) AS r, 40 - sum(floor(s)) OVER (PARTITION BY frame_id, semitone) AS lft FROM sh),
nn AS (SELECT *, CAST(n0 + CASE WHEN r <= lft THEN 1 ELSE 0 END AS BIGINT) AS n FROM rk),
st AS (SELECT *, sum(n) OVER (PARTITION BY frame_id, semitone ORDER BY c) - n AS base FROM nn),
ev AS (SELECT clip_id, frame_index, frame_id, semitone, CAST(base + j AS INT) AS pos, x + (qx - x) * (CAST(j AS DOUBLE) / n) AS x, y + (qy - y) * (CAST(j AS DOUBLE) / n) AS y FROM (SELECT *, unnest(range(n)) AS j FROM st) u)"""

MOVES = OUTLINES + """,
mv AS (SELECT e.clip_id, e.frame_index, e.semitone, e.pos, min(sqrt((d.x + (d.qx - d.x) * t - e.x)**2 + (d.y + (d.qy - d.y) * t - e.y)**2)) AS m FROM ev e JOIN (SELECT * FROM ed) d
 ON d.clip_id = e.clip_id AND d.semitone = e.semitone AND d.frame_index = e.frame_index - 1, LATERAL (SELECT greatest(0e0, least(1e0, ((e.x - d.x) * (d.qx - d.x) + (e.y - d.y) * (d.qy - d.y)) / (d.l * d.l))) AS t) tt GROUP BY 1, 2, 3, 4)"""


def outlines(spark, sf):
    f = F.col("frame_id")

    def corner(c):
        x = F.col("semitone") * 100.0 + (21.0 if c in (1, 2) else 0.0) + (f % 5).cast("double") / 2.0
        y = F.lit(50.0) + (83.0 if c >= 2 else 0.0) + (f % 3).cast("double") * 0.4
        return G.point(x, y + (f % 7).cast("double") if c == 2 else y)

    keys = view(spark, sf, "fx_frames").select("clip_id", "frame_index", "frame_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("semitone"))
    return keys.select("clip_id", "frame_index", "frame_id", F.lit(False).alias("black"), "semitone", F.array(*[corner(c) for c in range(4)]).alias("bar"))


@query("f16_resample", ("fx_frames",), "SELECT frame_id, semitone, pos, round(x, 6) AS x, round(y, 6) AS y FROM ev", OUTLINES)
def f16(spark, sf):
    even = motion.resample(outlines(spark, sf)).select("frame_id", "semitone", F.posexplode(F.arrays_zip("even_x", "even_y")).alias("pos", "p"))
    return even.select("frame_id", "semitone", "pos", r6("p.even_x").alias("x"), r6("p.even_y").alias("y"))


@query("f17_motion", ("fx_frames",), "SELECT clip_id, frame_index, semitone, pos, round(m, 6) AS move_px FROM mv", MOVES)
def f17(spark, sf):
    return motion.motion(outlines(spark, sf)).select("clip_id", "frame_index", "semitone", "pos", r6("move_px").alias("move_px"))


@query(
    "f18_steadiness",
    ("fx_frames",),
    """SELECT f.clip_id, f.frames, floor(m[CAST(floor(5e-1 * (n - 1)) AS BIGINT) + 1] * 1e2 + 5e-1) / 1e2 AS move_median, floor(m[CAST(floor(95e-2 * (n - 1)) AS BIGINT) + 1] * 1e2 + 5e-1) / 1e2 AS move_p95,
 floor(m[CAST(floor(999e-3 * (n - 1)) AS BIGINT) + 1] * 1e2 + 5e-1) / 1e2 AS move_p999, floor(s[1] * 1e2 + 5e-1) / 1e2 AS swing_median, floor(s[1] * 1e2 + 5e-1) / 1e2 AS swing_p95,
 CASE WHEN f.frames > 1 THEN floor(CAST(coalesce(j.n_jump, 0) AS DOUBLE) / (f.frames - 1) * 1e3 + 5e-1) / 1e3 END AS jumpy_frames
FROM (SELECT clip_id, count(DISTINCT frame_index) AS frames FROM fx_frames GROUP BY 1) f LEFT JOIN (SELECT clip_id, list_sort(list(m)) AS m, count(*) AS n FROM mv GROUP BY 1) q ON q.clip_id = f.clip_id
LEFT JOIN (SELECT clip_id, count(*) AS n_jump FROM (SELECT clip_id, frame_index FROM mv GROUP BY 1, 2 HAVING max(m) > 1e0) g GROUP BY 1) j ON j.clip_id = f.clip_id
LEFT JOIN (SELECT clip_id, list_sort(list(sw)) AS s FROM (SELECT clip_id, semitone, sqrt(var_pop(cx) + var_pop(cy)) AS sw FROM (SELECT clip_id, frame_id, semitone, avg(x) AS cx, avg(y) AS cy FROM ev GROUP BY 1, 2, 3) c GROUP BY 1, 2) w GROUP BY 1) z ON z.clip_id = f.clip_id""",
    MOVES,
)
def f18(spark, sf):
    return motion.steadiness(outlines(spark, sf))


LUMA = """
lum AS (SELECT frame_id, i AS row_, j AS col_, (value + 6e-1) * 2e2 AS luma, least(255, greatest(0, CAST(floor((value + 6e-1) * 2e2 + 5e-1) AS BIGINT))) AS lv FROM fx_cells),
kcell AS (SELECT frame_id, row_, col_, CASE WHEN col_ % 8 < 3 AND row_ < 9 THEN 1 ELSE 0 END AS black, CAST(floor(col_ / 8) AS INT) AS semitone FROM lum WHERE row_ % 5 <> 4
 UNION ALL SELECT frame_id, row_, col_, 0, 100 FROM lum WHERE row_ < 4)"""


def _otsu(source):
    return f"""
hist AS (SELECT frame_id, lv, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1, 2),
cum AS (SELECT frame_id, lv, sum(n) OVER (PARTITION BY frame_id ORDER BY lv) AS b, sum(n * lv) OVER (PARTITION BY frame_id ORDER BY lv) AS bs, sum(n) OVER (PARTITION BY frame_id) AS t, sum(n * lv) OVER (PARTITION BY frame_id) AS s FROM hist),
bw AS (SELECT frame_id, lv, CASE WHEN t > b THEN b * (t - b) * (bs / b - (s - bs) / (t - b)) ** 2 ELSE 0e0 END AS w FROM cum),
thr AS (SELECT frame_id, CAST(CASE WHEN max(w) > 0 THEN min(lv) FILTER (WHERE w = mw) ELSE 128 END AS INT) AS threshold FROM (SELECT *, max(w) OVER (PARTITION BY frame_id) AS mw FROM bw) x GROUP BY 1)"""


def pixels(spark, sf):
    return view(spark, sf, "fx_cells").select("frame_id", F.col("i").alias("row"), F.col("j").alias("col"), ((F.col("value") + 0.6) * 200.0).alias("luma"))


@query("f19_otsu", ("fx_cells",), "SELECT frame_id, threshold FROM thr", LUMA + "," + _otsu("lum"))
def f19(spark, sf):
    return motion.otsu(pixels(spark, sf), ["frame_id"])


KEYBED = LUMA + "," + _otsu("(SELECT DISTINCT l.frame_id, l.row_, l.col_, lv FROM lum l JOIN kcell k ON l.frame_id = k.frame_id AND l.row_ = k.row_ AND l.col_ = k.col_)")


@query(
    "f20_pixel_fit",
    ("fx_cells",),
    """SELECT k.frame_id, k.semitone, round(avg(CASE WHEN l.luma < t.threshold THEN 1e0 ELSE 0e0 END), 6) AS share FROM kcell k JOIN lum l ON l.frame_id = k.frame_id AND l.row_ = k.row_ AND l.col_ = k.col_ JOIN thr t ON t.frame_id = k.frame_id
 WHERE k.black = 1 GROUP BY 1, 2 UNION ALL SELECT k.frame_id, -1, round(avg(CASE WHEN l.luma >= t.threshold THEN 1e0 ELSE 0e0 END), 6) FROM kcell k JOIN lum l ON l.frame_id = k.frame_id AND l.row_ = k.row_ AND l.col_ = k.col_
 JOIN thr t ON t.frame_id = k.frame_id WHERE k.black = 0 AND NOT EXISTS (SELECT 1 FROM kcell b WHERE b.frame_id = k.frame_id AND b.row_ = k.row_ AND b.col_ = k.col_ AND b.black = 1) GROUP BY 1""",
    KEYBED,
)
def f20(spark, sf):
    p = pixels(spark, sf)
    black = (F.col("col") % 8 < 3) & (F.col("row") < 9)
    keys = p.where("row % 5 <> 4").select("frame_id", "row", "col", black.alias("black"), F.floor(F.col("col") / 8).cast("int").alias("semitone"))
    wide = p.where("row < 4").select("frame_id", "row", "col", F.lit(False).alias("black"), F.lit(100).alias("semitone"))
    dark, bright = motion.pixel_fit(keys.unionByName(wide), p)
    return dark.select("frame_id", "semitone", r6("dark_share").alias("share")).unionByName(
        bright.select("frame_id", F.lit(-1).alias("semitone"), r6("white_bright").alias("share"))
    )


@query(
    "g4_streaks",
    ("fx_frames",),
    """SELECT frame_id, frame_index - coalesce(max(CASE WHEN NOT hit THEN frame_index END) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING), -1) AS streak,
 CAST(hit AND NOT coalesce(lag(hit) OVER (PARTITION BY clip_id ORDER BY frame_index), false) AS INT) AS starts, CAST(NOT hit AND coalesce(lag(hit) OVER (PARTITION BY clip_id ORDER BY frame_index), false) AS INT) AS ends
FROM (SELECT *, presence < 6e-1 AS hit FROM fx_frames) f""",
)
def g4(spark, sf):
    frames = view(spark, sf, "fx_frames").select("clip_id", "frame_id", F.col("frame_index").cast("bigint").alias("frame_index"), "presence")
    s = sessions.streaks(frames, ["clip_id"], "frame_index", F.col("presence") < 0.6)
    return s.select("frame_id", "streak", F.col("starts").cast("int").alias("starts"), F.col("ends").cast("int").alias("ends"))


@query(
    "g6_ema",
    (),
    """SELECT event_type, event_id, round(ema, 6) AS ema FROM steps""",
    """e AS (SELECT event_type, event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS rn FROM events),
picked AS MATERIALIZED (SELECT event_type, event_id, value, CAST(floor(rn / 10) AS BIGINT) AS n FROM e WHERE rn % 10 = 0),
steps AS (SELECT event_type, event_id, n, value AS ema FROM picked WHERE n = 0 /*recursive*/ UNION ALL SELECT p.event_type, p.event_id, p.n, s.ema + 2e-1 * (p.value - s.ema) FROM steps s JOIN picked p ON p.event_type = s.event_type AND p.n = s.n + 1)""",
)
def g6(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", "value")
    return sessions.ema(events, ["event_type"], "event_id", "value", 0.2, 10).select("event_type", "event_id", r6("ema").alias("ema"))


DECODED = """
notes AS (SELECT device_id, ord, ts_ms, pitch, CASE WHEN b0 // 16 = 9 THEN b2 ELSE 0 END AS velocity FROM fx_notes WHERE b0 // 16 IN (8, 9)),
nx AS (SELECT *, lead(ts_ms) OVER w AS nt, lead(velocity) OVER w AS nv FROM notes WINDOW w AS (PARTITION BY device_id, pitch ORDER BY ts_ms, ord)),
iv AS (SELECT device_id, pitch, ord, ts_ms AS on_ms, velocity, CASE WHEN nv = 0 THEN nt END AS released_ms, CASE WHEN nv > 0 THEN nt END AS struck_again_ms FROM nx WHERE velocity > 0)"""


@query("g9_decode_notes", ("fx_notes",), "SELECT device_id, ord, ts_ms, pitch, velocity, CAST(velocity > 0 AS INT) AS is_on FROM notes", DECODED)
def g9(spark, sf):
    return sessions.decode_notes(view(spark, sf, "fx_notes")).withColumn("is_on", F.col("is_on").cast("int"))


def intervals(spark, sf):
    return sessions.note_intervals(sessions.decode_notes(view(spark, sf, "fx_notes")))


@query("g10_note_intervals", ("fx_notes",), "SELECT * FROM iv", DECODED)
def g10(spark, sf):
    return intervals(spark, sf)


GLOW = DECODED + """,
asks AS (SELECT device_id, pitch, ts_ms + (ord * 37) % 900 AS t_ms, ord AS ask FROM fx_notes),
glow AS (SELECT a.device_id, a.pitch, a.ask, a.t_ms, CASE WHEN i.on_ms IS NULL THEN 0e0 WHEN i.released_ms IS NULL OR a.t_ms < i.released_ms THEN i.velocity / 127e0 WHEN a.t_ms - i.released_ms >= 400 THEN 0e0
 ELSE i.velocity / 127e0 * (1e0 - (a.t_ms - i.released_ms) / 4e2) END AS level FROM asks a ASOF LEFT JOIN iv i ON a.device_id = i.device_id AND a.pitch = i.pitch AND a.t_ms >= i.on_ms)"""


def glow(spark, sf):
    asks = view(spark, sf, "fx_notes").select("device_id", "pitch", (F.col("ts_ms") + (F.col("ord") * 37) % 900).alias("t_ms"), F.col("ord").alias("ask"))
    return sessions.glow_at(asks, intervals(spark, sf))


@query("g11_glow_at", ("fx_notes",), "SELECT device_id, pitch, ask, t_ms, round(level, 6) AS level FROM glow", GLOW)
def g11(spark, sf):
    return glow(spark, sf).select("device_id", "pitch", "ask", "t_ms", r6("level").alias("level"))


@query(
    "g13_lit_keys",
    ("fx_notes",),
    """SELECT g.device_id, g.pitch, g.ask, o.semitone, round(g.level, 6) AS level FROM glow g JOIN (SELECT DISTINCT device_id, 48 + device_id % 5 AS low, s.semitone FROM fx_notes CROSS JOIN (SELECT unnest(range(16)) AS semitone) s) o
 ON g.device_id = o.device_id AND g.pitch = o.low + o.semitone WHERE g.level > 0""",
    GLOW,
)
def g13(spark, sf):
    devices = view(spark, sf, "fx_notes").select("device_id").distinct()
    boards = devices.select("device_id", (F.lit(48) + F.col("device_id") % 5).alias("lowest_pitch"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("semitone"))
    return sessions.lit_keys(boards, glow(spark, sf)).select("device_id", "pitch", "ask", "semitone", r6("level").alias("level"))


def stems(spark, sf):
    return view(spark, sf, "fx_frames").select(
        F.concat(F.lit("c"), F.col("clip_id").cast("string"), F.lit("-"), F.col("frame_id").cast("string")).alias("stem"),
        F.when(F.col("frame_id") % 10 < 5, "still").when(F.col("frame_id") % 10 < 8, "motion").otherwise("real").alias("source"),
    )


STEMS = """
stems AS (SELECT 'c' || CAST(clip_id AS VARCHAR) || '-' || CAST(frame_id AS VARCHAR) AS stem, CASE WHEN frame_id % 10 < 5 THEN 'still' WHEN frame_id % 10 < 8 THEN 'motion' ELSE 'real' END AS source FROM fx_frames),
hashed AS (SELECT *, CAST('0x' || substr(md5('7:' || stem), 1, 13) AS BIGINT) AS h FROM stems)"""


@query(
    "h1_split",
    ("fx_frames",),
    "SELECT stem, CAST(row_number() OVER (ORDER BY h, stem) <= greatest(1, round_even(count(*) OVER () * 3e-2, 0)) AS INT) AS held FROM hashed",
    STEMS,
)
def h1(spark, sf):
    return datasets.split(stems(spark, sf).select("stem"), seed=7).withColumn("held", F.col("held").cast("int"))


@query("h2_hold_out", ("fx_frames",), "SELECT stem, CAST(stem LIKE '%c12%' OR stem LIKE '%99-%' AS INT) AS held FROM stems WHERE source = 'real'", STEMS)
def h2(spark, sf):
    return datasets.hold_out(stems(spark, sf).where("source = 'real'").select("stem"), ["c12", "99-"]).withColumn("held", F.col("held").cast("int"))


@query(
    "h3_manifest",
    ("fx_frames",),
    """SELECT d.epoch, d.index, d.source, r.stem, CASE WHEN floor(d.index / 32) % 4 = 0 THEN 'search' ELSE 'track' END AS mode FROM (
 SELECT epoch, index, s.source, CAST(floor(u2 * s.n) AS BIGINT) + 1 AS rk FROM (SELECT CAST(floor(i / 640) AS BIGINT) AS epoch, i % 640 AS index,
  CAST('0x' || substr(md5('7:source:' || CAST(CAST(floor(i / 640) AS BIGINT) AS VARCHAR) || ':' || CAST(i % 640 AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496e0 AS u1,
  CAST('0x' || substr(md5('7:frame:' || CAST(CAST(floor(i / 640) AS BIGINT) AS VARCHAR) || ':' || CAST(i % 640 AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496e0 AS u2 FROM (SELECT unnest(range(1280)) AS i) r) u
 JOIN (SELECT source, count(*) AS n, CASE source WHEN 'motion' THEN 0e0 WHEN 'real' THEN 3e-1 ELSE 5e-1 END AS lo, CASE source WHEN 'motion' THEN 3e-1 WHEN 'real' THEN 5e-1 ELSE 2e0 END AS hi FROM stems GROUP BY 1) s ON u1 >= s.lo AND u1 < s.hi) d
JOIN (SELECT source, stem, row_number() OVER (PARTITION BY source ORDER BY h, stem) AS rk FROM hashed) r ON r.source = d.source AND r.rk = d.rk""",
    STEMS,
)
def h3(spark, sf):
    return datasets.manifest(stems(spark, sf), {"still": 0.5, "motion": 0.3, "real": 0.2}, 2, 640, 32, 7)


@query("h4_publish", ("fx_frames",), "SELECT source, stem FROM stems WHERE source <> 'real'", STEMS)
def h4(spark, sf):
    """Publishes two tables under a fresh version and reads them back."""
    import uuid

    from tonewheel.functions.lineage import checkpoint_dir

    s = stems(spark, sf)
    parts = {n: s.where(F.col("source") == n).select("stem") for n in ("still", "motion")}
    uri = sinks.publish(spark, parts, checkpoint_dir(spark), "corpus", uuid.uuid4().hex, required=("still", "motion"))
    return sinks.read_published(spark, uri, ("still", "motion"))


@query(
    "h5_write_scores",
    (),
    """SELECT 'm' || CAST(s_nationkey AS VARCHAR) || ' centroid' || CASE s_suppkey % 2 WHEN 0 THEN '' ELSE ' elevation low' END AS entry, CAST(sum(s_suppkey) AS BIGINT) AS frames, CAST(max(s_suppkey % 40) AS BIGINT) AS labels FROM supplier GROUP BY 1""",
)
def h5(spark, sf):
    sup = spark.read.parquet(f"{sf}/supplier.parquet")
    scores = sup.groupBy(
        F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("model"), F.lit("centroid").alias("decoder"),
        F.when(F.col("s_suppkey") % 2 == 0, "all").otherwise("elevation low").alias("view"),
    ).agg(F.sum("s_suppkey").alias("frames"), F.max(F.col("s_suppkey") % 40).alias("labels"))
    groups = scores.select("model", "decoder", "view", "frames", F.lit(0.0).alias("failure_rate"), F.lit("gaps").alias("grp"), "labels")
    docs = sinks.score_json(groups)
    return docs.select("entry", F.get_json_object("json", "$.frames").cast("bigint").alias("frames"), F.get_json_object("json", "$.groups.gaps.labels").cast("bigint").alias("labels"))


@query(
    "h6_keys_jsonl",
    ("fx_frames",),
    "SELECT frame_index AS frame, CAST(presence >= 6e-1 AS INT) AS tracked, CASE WHEN presence >= 6e-1 THEN white_keys END AS white_keys, CASE WHEN presence >= 6e-1 THEN 2 ELSE 0 END AS keys, clip_id FROM fx_frames",
)
def h6(spark, sf):
    f = view(spark, sf, "fx_frames")
    tracked = F.col("presence") >= 0.6
    key = F.struct(F.lit(0).alias("semitone"), F.lit(False).alias("black"), F.array(G.point(F.lit(1.0), F.lit(2.0))).alias("outline"))
    frames = f.select(
        "clip_id", F.col("frame_index").alias("frame"), (F.col("frame_index") * 33.0).alias("timestamp_ms"), F.lit(1.5).alias("process_ms"), F.lit(1.0).alias("model_ms"),
        tracked.alias("tracked"), F.when(tracked, F.struct("white_keys", F.lit("C").alias("lowest_phase"))).alias("board"), F.col("presence").alias("confidence"),
        F.when(tracked, F.array(key, key)).otherwise(F.array().cast("array<struct<semitone:int,black:boolean,outline:array<struct<x:double,y:double>>>>")).alias("keys"),
    )
    lines = sinks.keys_lines(frames)
    read = lines.select("clip_id", F.from_json("line", "frame BIGINT, tracked BOOLEAN, board STRUCT<white_keys: INT>, keys ARRAY<STRUCT<semitone: INT>>").alias("l"))
    return read.select(F.col("l.frame").alias("frame"), F.col("l.tracked").cast("int").alias("tracked"), F.col("l.board.white_keys").alias("white_keys"), F.size("l.keys").alias("keys"), "clip_id")


@query(
    "h7_metric_batches",
    (),
    """SELECT run, batch, items, first_key FROM (SELECT user_id % 3 AS run, CAST(floor((rn - 1) / 1000) AS BIGINT) AS batch, CAST(count(*) AS INT) AS items, arg_min(replace(event_type || ' ' || CAST(event_id AS VARCHAR), ' ', '_'), rn) AS first_key
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS rn FROM events) e GROUP BY 1, 2
 UNION ALL SELECT user_id % 3, CAST(ceil(count(*) / 1000) AS BIGINT), 1, NULL FROM events GROUP BY 1) b""",
)
def h7(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    metrics = e.select((F.col("user_id") % 3).alias("run"), F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("path"), "value")
    tags = metrics.select("run").distinct().select("run", F.lit("kind").alias("key"), F.lit("test").alias("value"))
    b = datasets.metric_batches(metrics, tags, 0)
    return b.select("run", "batch", "items", F.get_json_object("body", "$.metrics[0].key").alias("first_key"))


@query("h8_frame_names", ("fx_frames",), "SELECT frame_id, 'motion-' || CAST(clip_id AS VARCHAR) || '-' || lpad(CAST(frame_index AS VARCHAR), 4, '0') AS name FROM fx_frames")
def h8(spark, sf):
    f = view(spark, sf, "fx_frames").select("frame_id", F.col("clip_id").cast("string").alias("sequence"), F.col("frame_index").cast("int").alias("frame_index"))
    return datasets.frame_names(f).select("frame_id", "name")


@query("h9_corpus", ("fx_frames",), "SELECT source, count(*) AS frames, count(CASE WHEN h % 10 = 0 AND source <> 'real' THEN 1 END) AS held FROM hashed GROUP BY 1", STEMS)
def h9(spark, sf):
    s = stems(spark, sf)
    parts = {n: s.where(F.col("source") == n).select("stem", (datasets.seeded(7, "stem") % 10 == 0).alias("held")) for n in ("still", "motion", "real")}
    c = datasets.corpus(**parts)
    held = datasets.synthetic_validation(c).groupBy("source").agg(F.count(F.lit(1)).alias("held"))
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("frames")).join(held, "source", "left").select("source", "frames", F.coalesce("held", F.lit(0)).alias("held"))
