"""Queries of section E above the plane."""

from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.operators import lift
from tonewheel.plans.fitting import peaks, truth
from tonewheel.plans.registry import query, r6
from tonewheel.sources.fixtures import view


def fits(spark, sf, lifted=True):
    return truth(spark, sf).select(
        "frame_id", F.lit(0).alias("cand"), "white_keys", "phase", "width", "height", "homography",
        (F.when(F.col("frame_id") % 4 != 0, F.array("lift0", "lift1", "lift2")) if lifted else F.lit(None).cast("array<double>")).alias("lift"),
        ((F.col("frame_id") % 5 - 2).cast("double") / 50.0).alias("lens_k"), (F.col("width") / F.col("height")).alias("lens_aspect"),
    )


@query("e17_lift")
def e17(spark, sf):
    out = lift.estimate_lift(peaks(spark, sf), fits(spark, sf))
    return out.select("frame_id", *[F.round(G.at("lift", i), 4).alias(f"lift{i}") for i in range(3)])


@query("e18_black_depth")
def e18(spark, sf):
    return lift.black_depth(peaks(spark, sf), fits(spark, sf)).select("frame_id", F.round("black_depth", 4).alias("black_depth"))


@query("e19_lens_bend")
def e19(spark, sf):
    straight = fits(spark, sf).withColumn("lens_k", F.lit(0.0))
    return lift.lens_bend(peaks(spark, sf), straight).select("frame_id", F.round("bend", 3).alias("bend"))


FACE_VIEWS = ("fx_truth", "fx_board_keys")
FACES = """
corner AS (SELECT t.*, k.semitone, k.black, c.pos, CASE WHEN c.pos IN (1, 2) THEN k.x_to ELSE k.x_from END AS kx, CASE WHEN c.pos >= 2 THEN k.depth ELSE 0e0 END AS ky, CASE WHEN t.frame_id % 4 <> 0 THEN 1 ELSE 0 END AS has
 FROM fx_truth t JOIN fx_board_keys k ON t.white_keys = k.white_keys AND t.phase = k.phase CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS pos) c),
face AS (SELECT frame_id, CAST(semitone AS INT) AS semitone, black, CAST(pos AS INT) AS pos, (h0*kx + h1*ky + h2) / (h6*kx + h7*ky + h8) AS fx, (h3*kx + h4*ky + h5) / (h6*kx + h7*ky + h8) AS fy,
 (h0*kx + h1*ky + h2 + black*has*lift0) / (h6*kx + h7*ky + h8 + black*has*lift2) AS tx, (h3*kx + h4*ky + h5 + black*has*lift1) / (h6*kx + h7*ky + h8 + black*has*lift2) AS ty FROM corner)"""


@query(
    "e20_key_faces",
    FACE_VIEWS,
    """SELECT frame_id, semitone, black, pos, round(tx, 11) AS top_x, round(ty, 11) AS top_y, CASE WHEN black = 1 THEN round(fx, 11) END AS foot_x, CASE WHEN black = 1 THEN round(fy, 11) END AS foot_y FROM face""",
    FACES,
)
def e20(spark, sf):
    corners = lift.face_corners(fits(spark, sf))
    places = [F.round(c, 11).alias(c) for c in ("top_x", "top_y", "foot_x", "foot_y")]
    return corners.select("frame_id", "semitone", F.col("black").cast("int").alias("black"), "pos", *places)


# hull sides leave from a corner with every other point to their left or on them; corners go round by angle
OUTLINES = FACES + """,
spots AS (SELECT DISTINCT frame_id, semitone, x, y FROM (SELECT frame_id, semitone, tx AS x, ty AS y FROM face WHERE black = 1 UNION ALL SELECT frame_id, semitone, fx, fy FROM face WHERE black = 1) s),
turns AS (SELECT a.frame_id, a.semitone, a.x, a.y, b.x AS bx, b.y AS by_, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn, (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) AS within
 FROM spots a JOIN spots b ON a.frame_id = b.frame_id AND a.semitone = b.semitone AND (a.x <> b.x OR a.y <> b.y) JOIN spots c ON a.frame_id = c.frame_id AND a.semitone = c.semitone),
hull AS (SELECT DISTINCT frame_id, semitone, x, y FROM (SELECT frame_id, semitone, x, y, bx, by_ FROM turns GROUP BY ALL HAVING count(CASE WHEN turn > 0 OR (turn = 0 AND within <= 0) THEN 1 END) = count(*)) h),
angled AS (SELECT h.*, atan2(y - avg(y) OVER g, x - avg(x) OVER g) AS angle FROM hull h WINDOW g AS (PARTITION BY frame_id, semitone)),
firsts AS (SELECT frame_id, semitone, max(CASE WHEN pos = 0 THEN tx END) AS x0, max(CASE WHEN pos = 0 THEN ty END) AS y0, sum(tx * ny - nx * ty) AS area FROM (
 SELECT *, coalesce(lead(tx) OVER w, first_value(tx) OVER w) AS nx, coalesce(lead(ty) OVER w, first_value(ty) OVER w) AS ny FROM face WHERE black = 1 WINDOW w AS (PARTITION BY frame_id, semitone ORDER BY pos)) t GROUP BY 1, 2),
ranked AS (SELECT g.*, row_number() OVER (PARTITION BY g.frame_id, g.semitone ORDER BY CASE WHEN area < 0 THEN -angle ELSE angle END) - 1 AS r, count(*) OVER (PARTITION BY g.frame_id, g.semitone) AS n,
 row_number() OVER (PARTITION BY g.frame_id, g.semitone ORDER BY (g.x - x0)**2 + (g.y - y0)**2) AS near FROM angled g JOIN firsts f ON f.frame_id = g.frame_id AND f.semitone = g.semitone),
ring AS (SELECT k.frame_id, k.semitone, 1 AS black, CAST((k.r - s.r + k.n) % k.n AS INT) AS pos, k.x, k.y FROM ranked k JOIN ranked s ON s.frame_id = k.frame_id AND s.semitone = k.semitone AND s.near = 1
 UNION ALL SELECT frame_id, semitone, 0, pos, tx, ty FROM face WHERE black = 0),
lens AS (SELECT r.*, CAST(r.frame_id % 5 - 2 AS DOUBLE) / 5e1 AS k, CAST(t.width AS DOUBLE) / t.height AS a FROM ring r JOIN fx_truth t ON t.frame_id = r.frame_id),
off AS (SELECT *, sqrt(a * a + 1e0) / 2e0 AS reach, (x - 5e-1) * a / (sqrt(a * a + 1e0) / 2e0) AS dx, (y - 5e-1) / (sqrt(a * a + 1e0) / 2e0) AS dy FROM lens),
bending AS (SELECT *, sqrt(dx * dx + dy * dy) AS s, 1e0 - k * (dx * dx + dy * dy) * 4e0 AS room FROM off),
bent AS (SELECT *, CASE WHEN s < 1e-12 OR abs(k) < 1e-12 OR room < 0 THEN 1e0 ELSE (1e0 - sqrt(greatest(room, 0e0))) / (k * s * 2e0) / s END AS scale FROM bending)"""


@query(
    "e21_key_outlines", FACE_VIEWS,
    "SELECT frame_id, semitone, CAST(black AS INT) AS black, pos, round(5e-1 + dx * scale * reach / a, 10) AS x, round(5e-1 + dy * scale * reach, 10) AS y FROM bent", OUTLINES,
)
def e21(spark, sf):
    out = lift.key_outlines(fits(spark, sf))
    # an outer explode: for a plain one the optimizer asks first whether a bar is empty, and makes every bar twice
    rows = out.select("frame_id", "semitone", "black", F.posexplode_outer("bar").alias("pos", "p")).where("pos is not null")
    return rows.select(
        "frame_id", "semitone", F.col("black").cast("int").alias("black"), "pos", F.round("p.x", 10).alias("x"), F.round("p.y", 10).alias("y")
    )


PREFILL = """
tp AS MATERIALIZED (SELECT t.*, p.channel, p.ord, (h0*p.x + h1*p.y + h2) / (h6*p.x + h7*p.y + h8) * width AS px, (h3*p.x + h4*p.y + h5) / (h6*p.x + h7*p.y + h8) * height AS py,
 (h0*p.x + h2 + lift0) / (h6*p.x + h8 + lift2) * width AS lx, (h3*p.x + h5 + lift1) / (h6*p.x + h8 + lift2) * height AS ly,
 sqrt((((h0 + h1 + h2) / (h6 + h7 + h8) - (h1 + h2) / (h7 + h8)) * width)**2 + (((h3 + h4 + h5) / (h6 + h7 + h8) - (h4 + h5) / (h7 + h8)) * height)**2) AS kw
 FROM fx_truth t JOIN fx_template p ON t.white_keys = p.white_keys AND t.phase = p.phase),
want AS MATERIALIZED (SELECT frame_id, channel + 2 AS channel, ord, px AS x, py AS y, kw, 0 AS keep FROM tp WHERE channel IN (5, 6)
 UNION ALL SELECT frame_id, channel + 5, ord, CASE WHEN frame_id % 4 <> 0 THEN lx END, CASE WHEN frame_id % 4 <> 0 THEN ly END, kw, 1 FROM tp WHERE channel IN (5, 6)),
tops AS MATERIALIZED (SELECT frame_id, channel, ord, x * width AS fx, y * height AS fy FROM fx_fit_peaks WHERE channel IN (7, 8, 10, 11)),
met AS (SELECT w.frame_id, w.channel, w.ord, w.kw, p.fx, p.fy, p.ord AS po, sqrt((p.fx - w.x)**2 + (p.fy - w.y)**2) AS d FROM want w JOIN tops p ON p.frame_id = w.frame_id AND p.channel = w.channel),
cands AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame_id, channel, ord ORDER BY d, po DESC) AS rn FROM met WHERE d <= kw)"""


@query(
    "e22_prefill",
    ("fx_truth", "fx_template", "fx_fit_peaks"),
    """SELECT frame_id, CAST(channel AS INT) AS channel, CAST(ord AS BIGINT) AS ord, round(px, 6) AS x_px, round(py, 6) AS y_px FROM tp
UNION ALL SELECT w.frame_id, w.channel, w.ord, round(coalesce(c.fx, CASE WHEN keep = 1 THEN w.x END), 6), round(coalesce(c.fy, CASE WHEN keep = 1 THEN w.y END), 6) FROM want w LEFT JOIN cands c ON c.frame_id = w.frame_id AND c.channel = w.channel AND c.ord = w.ord AND c.rn = 1""",
    PREFILL,
)
def e22(spark, sf):
    return lift.prefill(fits(spark, sf), peaks(spark, sf)).select("frame_id", "channel", "ord", r6("x_px").alias("x_px"), r6("y_px").alias("y_px"))


@query("e23_reproject")
def e23(spark, sf):
    drawn = view(spark, sf, "fx_drawn").select(
        "frame_id", F.col("channel").cast("int").alias("channel"), F.col("ord").cast("bigint").alias("ord"),
        F.when(F.col("h1") != 0, F.col("x_px")).alias("x_px"), F.when(F.col("h1") != 0, F.col("y_px")).alias("y_px"),
    )
    out = lift.reproject(drawn, view(spark, sf, "fx_boards").select("frame_id", "white_keys", "phase"), 1)
    return out.select("frame_id", "channel", "ord", F.round("x_px", 3).alias("x_px"), F.round("y_px", 3).alias("y_px"))
