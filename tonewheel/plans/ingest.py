"""Queries of section A."""

from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions.lineage import cut, spread
from tonewheel.operators import ingest
from tonewheel.plans.detection import quads
from tonewheel.plans.registry import query, r6
from tonewheel.sources import sidecars
from tonewheel.sources.fixtures import view

MALFORMED = [
    "invalid image dimensions", "must list keys", "has keys but no corners", "ignoreMask must name a file",
    "sequence must be a string", "frameIndex must be an int", "cornerVisible must list 4 booleans",
    "keybed quad must list exactly 4 corners", "keybed quad corner 2 is not an object",
    "keybed quad corner 1 has invalid coordinates", "key entry must be an object",
    "key entry has invalid pitch or black flag", "key top face must list exactly 4 corners",
    "key front face corner 0 has invalid coordinates", "not a json object", "not valid json",
]


def _frac(expr):
    return F.concat(F.lit("0."), expr.cast("string"))


def _xy(x, y):
    return F.concat(F.lit('{"x":'), _frac(x), F.lit(',"y":'), _frac(y), F.lit("}"))


def _list(*items):
    parts = [F.lit("[")]
    for n, item in enumerate(items):
        parts += ([F.lit(",")] if n else []) + [item]
    return F.concat(*parts, F.lit("]"))


def sidecar_texts(spark, sf):
    """One sidecar text per customer, sixteen in twenty-four of them malformed in a known way."""
    k = F.col("c_custkey")
    m = k % 24
    xs = [F.lit(100) + k % 50, F.lit(800) + k % 50, F.lit(810) + k % 50, F.lit(110) + k % 50]
    ys = [F.lit(300) + k % 70, F.lit(310) + k % 70, F.lit(500) + k % 70, F.lit(490) + k % 70]
    pts = [_xy(x, y) for x, y in zip(xs, ys)]
    corners = (
        F.when(m.isin(2, 16), "null").when(m == 7, _list(*pts[:3])).when(m == 8, _list(pts[0], pts[1], F.lit("3"), pts[3]))
        .when(m == 9, _list(pts[0], F.lit('{"x":"1","y":0.5}'), pts[2], pts[3])).otherwise(_list(*pts))
    )
    top = [_xy(F.lit(200) + k % 90 + 10 * (c in (1, 2)), F.lit(300) + k % 80 + 100 * (c >= 2)) for c in range(4)]
    front = [_xy(F.lit(200) + k % 90 + 10 * (c in (1, 2)), F.lit(400) + k % 80 + 20 * (c >= 2)) for c in range(4)]
    bad_front = _list(F.lit('{"x":null,"y":0.5}'), *front[1:])

    def key(pitch, black, top_text, front_text):
        return F.concat(
            F.lit('{"pitch":'), pitch, F.lit(f',"black":{black},"top":'), top_text, F.lit(',"front":'), front_text, F.lit("}")
        )

    first = key(F.when(m == 11, "60.5").otherwise("60"), "false", F.when(m == 12, "{}").otherwise(_list(*top)), F.lit("null"))
    second = F.when(m == 10, "7").otherwise(key(F.lit("61"), "true", _list(*top), F.when(m == 13, bad_front).otherwise(_list(*front))))
    keys = F.when(m == 1, "{}").when(m == 16, "[]").otherwise(_list(first, second))
    body = F.concat(
        F.lit('{"kind":"'), F.when(k % 3 == 0, "real-keys").otherwise("synth"), F.lit('","imageWidth":'),
        F.when(m == 0, '"640"').otherwise("640"), F.lit(',"imageHeight":480,"corners":'), corners, F.lit(',"keys":'), keys,
        F.when(m == 3, ',"ignoreMask":5').otherwise(""),
        F.when(m == 4, ',"sequence":7').otherwise(F.concat(F.lit(',"sequence":"s'), (k % 9).cast("string"), F.lit('"'))),
        F.when(m == 5, ',"frameIndex":1.5').otherwise(F.concat(F.lit(',"frameIndex":'), k.cast("string"))),
        F.when(m == 6, ',"cornerVisible":[true,true,false]').otherwise(',"cornerVisible":[true,true,false,true]'), F.lit("}"),
    )
    text = F.when(m == 14, "[1]").when(m == 15, '{"a":').otherwise(body)
    return spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), "c_custkey").select(
        k.alias("frame_id"), F.concat(F.lit("/clips/c"), (k % 7).cast("string"), F.lit("-"), k.cast("string"), F.lit(".json")).alias("path"), text.alias("text")
    )


def good_frames(spark, sf):
    """The well-formed sidecars, stored: filters on them would otherwise move below the spread, into the few tasks that read
    customers, and parse every text again."""
    ok, _ = sidecars.validate(cut(sidecar_texts(spark, sf)))
    return cut(sidecars.parse(ok))


@query("a1_read_sidecars", (), "SELECT c_custkey AS frame_id, 'c' || CAST(c_custkey % 7 AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) AS stem FROM customer WHERE c_custkey % 9 <> 0")
def a1(spark, sf):
    texts = sidecar_texts(spark, sf)
    images = texts.where("frame_id % 9 <> 0").select(F.regexp_replace("path", "json$", "png").alias("path"))
    return sidecars.pair_with_images(texts, images).select("frame_id", "stem")


@query(
    "a2_validate",
    (),
    "SELECT c_custkey AS frame_id, CASE c_custkey % 24 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(MALFORMED)) + " ELSE 'ok' END AS reason FROM customer",
)
def a2(spark, sf):
    checked = sidecars.with_reason(sidecar_texts(spark, sf))
    return checked.select("frame_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


GOOD = "c_custkey % 24 >= 16"


@query(
    "a3_to_pixels",
    (),
    f"""SELECT c_custkey AS frame_id, pos, round((CASE pos WHEN 0 THEN 100 WHEN 1 THEN 800 WHEN 2 THEN 810 ELSE 110 END + c_custkey % 50) / 1e3 * 640, 6) AS x_px,
 round((CASE pos WHEN 0 THEN 300 WHEN 1 THEN 310 WHEN 2 THEN 500 ELSE 490 END + c_custkey % 70) / 1e3 * 480, 6) AS y_px
FROM customer CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS pos) p WHERE {GOOD} AND c_custkey % 24 <> 16""",
)
def a3(spark, sf):
    px = sidecars.to_pixels(good_frames(spark, sf))
    return px.select("frame_id", F.posexplode("corners").alias("pos", "p")).select("frame_id", "pos", r6("p.x").alias("x_px"), r6("p.y").alias("y_px"))


@query(
    "a4_explode_keys",
    (),
    f"""SELECT c_custkey AS frame_id, pitch, CAST(pitch = 61 AS INT) AS black, face, corner,
 round((200 + c_custkey % 90 + CASE WHEN corner IN (1, 2) THEN 10 ELSE 0 END) / 1e3 * 640, 6) AS x_px,
 round((CASE face WHEN 'top' THEN 300 ELSE 400 END + c_custkey % 80 + CASE WHEN corner >= 2 THEN CASE face WHEN 'top' THEN 100 ELSE 20 END ELSE 0 END) / 1e3 * 480, 6) AS y_px
FROM customer CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS corner) c CROSS JOIN (SELECT 60 AS pitch, 'top' AS face UNION ALL SELECT 61, 'top' UNION ALL SELECT 61, 'front') f
WHERE {GOOD} AND c_custkey % 24 <> 16""",
)
def a4(spark, sf):
    keys = sidecars.explode_keys(sidecars.to_pixels(good_frames(spark, sf)))
    return sidecars.key_corners(keys).select(
        "frame_id", "pitch", F.col("black").cast("int").alias("black"), "face", "corner", r6("x_px").alias("x_px"), r6("y_px").alias("y_px")
    )


@query(
    "a5_frame_flags",
    (),
    f"SELECT c_custkey AS frame_id, CAST(c_custkey % 3 = 0 AS INT) AS is_real, CAST(c_custkey % 24 = 16 AS INT) AS is_negative FROM customer WHERE {GOOD}",
)
def a5(spark, sf):
    flags = sidecars.frame_flags(good_frames(spark, sf))
    return flags.select("frame_id", F.col("is_real").cast("int").alias("is_real"), F.col("is_negative").cast("int").alias("is_negative"))


def fixed_texts(spark, sf):
    """One corrected-label text per customer; one in four predates the rear kinds."""
    k = F.col("c_custkey")

    def pair(c, i):
        p = F.format_string("[%d,%d]", k % 100 + c * 7 + i * 3, k % 50 + c * 5 + i)
        return F.when((k + c + i) % 5 == 0, "null").otherwise(p)

    def kind(name, c, n):
        return F.concat(F.lit(f',"{name}":'), _list(*[pair(c, i) for i in range(n)]))

    counts = {"corners": 4, "gaps": 3, "backGaps": 3}
    fields = {n: kind(n, c, counts.get(n, 2)) for n, c in sidecars.FIXED_KINDS.items()}
    front = [v for n, v in fields.items() if n not in sidecars.BACK_FILL]
    rear = F.when(k % 4 == 0, "").otherwise(F.concat(*[fields[n] for n in sidecars.BACK_FILL]))
    text = F.concat(F.lit('{"width":640,"height":480,"whiteKeys":4,"phase":"C"'), *front, rear, F.lit("}"))
    return spread(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), "c_custkey").select(k.alias("frame_id"), text.alias("text"))


FIXED = """
slots AS (SELECT c_custkey AS k, c, n, unnest(range(n)) AS i FROM customer CROSS JOIN
 (SELECT unnest([0, 4, 5, 6, 7, 8, 9, 10, 11]) AS c, unnest([4, 3, 2, 2, 2, 2, 3, 2, 2]) AS n) s),
fixed AS (SELECT k AS frame_id, CAST(CASE WHEN c = 0 THEN i ELSE c END AS INT) AS channel, CAST(CASE WHEN c = 0 THEN 0 ELSE i END AS INT) AS idx,
 CAST(k % 100 + c * 7 + i * 3 AS DOUBLE) AS x_px, CAST(k % 50 + c * 5 + i AS DOUBLE) AS y_px, CAST(k % 4 = 0 AS INT) AS lacks_rear
 FROM slots WHERE (k + c + i) % 5 <> 0 AND NOT (k % 4 = 0 AND c >= 9))"""


@query("a6_fixed_labels", (), "SELECT * FROM fixed", FIXED)
def a6(spark, sf):
    points = sidecars.fixed_points(sidecars.parse_fixed(fixed_texts(spark, sf)))
    return points.withColumn("lacks_rear", F.col("lacks_rear").cast("int"))


@query(
    "a7_export_labels",
    (),
    """SELECT s.frame_id, s.kind, s.pos, f.x_px, f.y_px FROM (SELECT c_custkey AS frame_id, kind, CAST(unnest(range(n)) AS INT) AS pos FROM customer CROSS JOIN
 (SELECT unnest(['corners', 'gaps', 'blackLow', 'blackHigh']) AS kind, unnest([4, 3, 2, 2]) AS n) x) s
LEFT JOIN fixed f ON f.frame_id = s.frame_id AND ((kind = 'corners' AND f.channel = pos AND f.channel <= 3) OR (kind = 'gaps' AND f.channel = 4 AND f.idx = pos)
 OR (kind = 'blackLow' AND f.channel = 5 AND f.idx = pos) OR (kind = 'blackHigh' AND f.channel = 6 AND f.idx = pos))""",
    FIXED,
)
def a7(spark, sf):
    fixed = sidecars.parse_fixed(fixed_texts(spark, sf))
    frames = fixed.select("frame_id", "width", "height", F.col("whiteKeys").alias("white_keys"), F.size("blackLow").alias("blacks"))
    docs = sidecars.export_labels(sidecars.fixed_points(fixed), frames)
    read = docs.select("frame_id", F.from_json("json", sidecars.FIXED_SCHEMA).alias("d"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"d.{k}").alias("points")) for k in ("corners", "gaps", "blackLow", "blackHigh")])
    return read.select("frame_id", F.explode(kinds).alias("k")).select(
        "frame_id", "k.kind", F.posexplode("k.points").alias("pos", "p")
    ).select("frame_id", "kind", "pos", F.get("p", 0).alias("x_px"), F.get("p", 1).alias("y_px"))


SHAPE = """
e AS (SELECT *, sqrt((x1-x0)**2 + (y1-y0)**2) AS e0, sqrt((x2-x1)**2 + (y2-y1)**2) AS e1, sqrt((x3-x2)**2 + (y3-y2)**2) AS e2, sqrt((x0-x3)**2 + (y0-y3)**2) AS e3,
 sign((x1-x0)*(y2-y0) - (y1-y0)*(x2-x0)) AS s0, sign((x2-x1)*(y3-y1) - (y2-y1)*(x3-x1)) AS s1,
 sign((x3-x2)*(y0-y2) - (y3-y2)*(x0-x2)) AS s2, sign((x0-x3)*(y1-y3) - (y0-y3)*(x1-x3)) AS s3 FROM fx_quads),
m AS (SELECT *, ((e0 + e2) / 2e0) / greatest((e1 + e3) / 2e0, 1e-2) AS aspect, greatest(e1, e3) / greatest(least(e1, e3), 1e-2) AS ratio FROM e),
shape AS (SELECT *, CASE WHEN s0 = 0 OR s1 <> s0 OR s2 <> s0 OR s3 <> s0 THEN 'corners fold over' WHEN least(e0, e1, e2, e3) < 1e-2 THEN 'corners collapsed'
 WHEN aspect < 18e-1 OR aspect > 3e1 THEN 'aspect ' || CAST(floor(aspect * 1e1 + 5e-1) / 1e1 AS VARCHAR) || ' is not a keybed'
 WHEN ratio > 32e-1 THEN 'one end drawn ' || CAST(floor(ratio * 1e1 + 5e-1) / 1e1 AS VARCHAR) || 'x the other' ELSE '' END AS reason FROM m)"""


@query("a8_check_quad", ("fx_quads",), "SELECT frame_id, CAST(reason = '' AS INT) AS usable, reason FROM shape", SHAPE)
def a8(spark, sf):
    return ingest.check_quad(quads(spark, sf)).select("frame_id", F.col("usable").cast("int").alias("usable"), "reason")


@query(
    "a8_gate_captures",
    ("fx_quads",),
    "SELECT frame_id, CASE WHEN frame_id % 2 = 0 THEN 'rec' ELSE 'snap' END AS kind, CAST(reason = '' AS INT) AS has_quad FROM shape WHERE frame_id % 2 = 0 OR reason = ''",
    SHAPE,
)
def a8_gate(spark, sf):
    shots = quads(spark, sf).withColumn("kind", F.when(F.col("frame_id") % 2 == 0, "rec").otherwise("snap"))
    return ingest.gate_captures(shots).select("frame_id", "kind", F.col("quad").isNotNull().cast("int").alias("has_quad"))


@query(
    "a9_canonical_quad",
    ("fx_quads",),
    """SELECT frame_id, pos, CASE (pos + r) % 4 WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS x, CASE (pos + r) % 4 WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS y
FROM (SELECT *, CASE WHEN sqrt((x1-x0)**2 + (y1-y0)**2) >= sqrt((x3-x0)**2 + (y3-y0)**2) THEN 0 ELSE 1 END AS r FROM fx_quads) q CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS pos) p""",
)
def a9(spark, sf):
    q = quads(spark, sf).select("frame_id", F.posexplode(ingest.canonical_quad("quad")).alias("pos", "p"))
    return q.select("frame_id", "pos", "p.x", "p.y")


@query("a10_keep_visible", ("fx_frames",), "SELECT frame_id, presence AS visible_fraction FROM fx_frames WHERE presence >= 2e-1")
def a10(spark, sf):
    return ingest.keep_visible(view(spark, sf, "fx_frames").select("frame_id", F.col("presence").alias("visible_fraction")))


def stems(spark, sf):
    f = view(spark, sf, "fx_frames")
    return f.select("frame_id", F.concat(F.lit("clip"), F.col("clip_id").cast("string"), F.when(F.col("frame_id") % 5 == 0, "").otherwise(F.concat(F.lit("-"), F.lpad(F.col("frame_index").cast("string"), 4, "0")))).alias("stem"),
                    (F.col("frame_id") % 7 != 0).alias("piano"))


STEMS = """
stems AS (SELECT frame_id, 'clip' || CAST(clip_id AS VARCHAR) || CASE WHEN frame_id % 5 = 0 THEN '' ELSE '-' || lpad(CAST(frame_index AS VARCHAR), 4, '0') END AS stem FROM fx_frames)"""


@query("a11_clip_filter", ("fx_frames",), "SELECT frame_id, CAST(stem LIKE '%p12%' OR stem LIKE '%7-00%' AS INT) AS listed, CAST(starts_with(stem, 'clip1') OR starts_with(stem, 'lip') AS INT) AS started FROM stems", STEMS)
def a11(spark, sf):
    return stems(spark, sf).select(
        "frame_id", ingest.in_clips("stem", ["p12", "7-00"]).cast("int").alias("listed"),
        ingest.in_clips("stem", ["clip1", "lip"], "startswith").cast("int").alias("started"),
    )


@query("a12_run_key", ("fx_frames",), "SELECT frame_id, split_part(stem, '-', 1) AS run FROM stems WHERE frame_id % 7 <> 0", STEMS)
def a12(spark, sf):
    return ingest.runs(stems(spark, sf)).select("frame_id", "run")


@query(
    "a13_grid_coverage",
    ("fx_frames",),
    """SELECT e AS elevation, a AS azimuth, d AS distance, count(CASE WHEN presence >= 2e-1 THEN 1 END) AS saved, count(CASE WHEN presence < 2e-1 THEN 1 END) AS skipped
FROM (SELECT unnest([10, 25, 40, 55, 70]) AS e) x CROSS JOIN (SELECT unnest([-90, -60, -30, 0, 30, 60, 90]) AS a) y CROSS JOIN (SELECT unnest([0, 1, 2]) AS d) z
LEFT JOIN fx_frames f ON f.frame_id % 11 * 5 + 10 = e AND f.frame_id % 8 * 30 - 90 = a AND f.frame_id % 3 = d GROUP BY 1, 2, 3""",
)
def a13(spark, sf):
    f = F.col("frame_id")
    frames = view(spark, sf, "fx_frames").select(
        (f % 11 * 5 + 10).alias("elevation"), (f % 8 * 30 - 90).alias("azimuth"), (f % 3).alias("distance"), F.col("presence").alias("visible_fraction")
    )
    return ingest.grid_coverage(frames)
