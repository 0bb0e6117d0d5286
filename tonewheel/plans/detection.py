"""Queries of section D."""

from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.operators import detect
from tonewheel.plans.registry import query, r6
from tonewheel.sources.fixtures import view

PEAKS = """
peaks AS (SELECT c.frame_id, c.i, c.j, c.value FROM fx_cells c WHERE c.value >= 15e-2 AND NOT EXISTS (
 SELECT 1 FROM fx_cells n WHERE n.frame_id = c.frame_id AND abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND n.value > c.value))"""

ZERO = PEAKS + """,
around AS (SELECT p.frame_id, p.i, p.j, p.value, sum(greatest(n.value, 0e0)) AS t, sum(greatest(n.value, 0e0) * (n.i - p.i)) AS di,
 sum(greatest(n.value, 0e0) * (n.j - p.j)) AS dj FROM peaks p JOIN fx_cells n ON n.frame_id = p.frame_id
 AND abs(n.i - p.i) <= 1 AND abs(n.j - p.j) <= 1 GROUP BY 1, 2, 3, 4),
refined AS (SELECT *, i + di / t AS ri, j + dj / t AS rj FROM around)"""

CLAMPED = PEAKS + """,
size AS (SELECT frame_id, max(i) AS mi, max(j) AS mj FROM fx_cells GROUP BY 1),
win AS (SELECT p.frame_id, p.i, p.j, d.di, e.dj, n.value AS v FROM peaks p JOIN size s ON s.frame_id = p.frame_id
 CROSS JOIN (SELECT unnest([-1, 0, 1]) AS di) d CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dj) e
 JOIN fx_cells n ON n.frame_id = p.frame_id AND n.i = least(greatest(p.i + d.di, 0), s.mi) AND n.j = least(greatest(p.j + e.dj, 0), s.mj))"""


def heat_rows(spark, sf):
    return view(spark, sf, "fx_heat_rows").select(
        "frame_id", "i", F.col("embedding").cast("array<double>").alias("v")
    )


def peaks(spark, sf):
    return detect.grid_peaks(heat_rows(spark, sf), 0.15, ["frame_id"])


@query("d1_peaks", ("fx_cells",), "SELECT frame_id, i, j, round(value, 6) AS value FROM peaks", PEAKS)
def d1(spark, sf):
    return peaks(spark, sf).select("frame_id", "i", "j", r6("value").alias("value"))


@query("d1_peaks_sparse", ("fx_cells",), "SELECT frame_id, i, j, round(value, 6) AS value FROM peaks", PEAKS)
def d1_sparse(spark, sf):
    cells = view(spark, sf, "fx_cells").where("value > -0.2")
    return detect.local_maxima(cells, 0.15, ["frame_id"]).select("frame_id", "i", "j", r6("value").alias("value"))


REFINED = "SELECT frame_id, i, j, round(ri, 6) AS ri, round(rj, 6) AS rj FROM refined"


def refined(df):
    return df.select("frame_id", "i", "j", r6("ri").alias("ri"), r6("rj").alias("rj"))


@query("d2_centroid", ("fx_cells",), REFINED, ZERO)
def d2(spark, sf):
    return refined(detect.refine_centroid(peaks(spark, sf)))


@query(
    "d2_centroid_repeat",
    ("fx_cells",),
    """SELECT frame_id, i, j, round(i + sum(greatest(v, 0e0) * di) / sum(greatest(v, 0e0)), 6) AS ri,
 round(j + sum(greatest(v, 0e0) * dj) / sum(greatest(v, 0e0)), 6) AS rj FROM win GROUP BY 1, 2, 3""",
    CLAMPED,
)
def d2_repeat(spark, sf):
    return refined(detect.refine_centroid(peaks(spark, sf), "repeat"))


@query(
    "d3_parabola",
    ("fx_cells",),
    """SELECT frame_id, i, j,
 round(i + CASE WHEN u - 2e0 * m + d >= 0 THEN 0e0 ELSE greatest(-5e-1, least(5e-1, 5e-1 * (u - d) / (u - 2e0 * m + d))) END, 6) AS ri,
 round(j + CASE WHEN l - 2e0 * m + r >= 0 THEN 0e0 ELSE greatest(-5e-1, least(5e-1, 5e-1 * (l - r) / (l - 2e0 * m + r))) END, 6) AS rj
FROM (SELECT frame_id, i, j, max(CASE WHEN di = -1 AND dj = 0 THEN ln(greatest(v, 1e-6)) END) AS u,
 max(CASE WHEN di = 1 AND dj = 0 THEN ln(greatest(v, 1e-6)) END) AS d, max(CASE WHEN di = 0 AND dj = -1 THEN ln(greatest(v, 1e-6)) END) AS l,
 max(CASE WHEN di = 0 AND dj = 1 THEN ln(greatest(v, 1e-6)) END) AS r, max(CASE WHEN di = 0 AND dj = 0 THEN ln(greatest(v, 1e-6)) END) AS m
 FROM win GROUP BY 1, 2, 3) x""",
    CLAMPED,
)
def d3(spark, sf):
    return refined(detect.refine_parabola(peaks(spark, sf)))


@query(
    "d4_offset",
    ("fx_cells",),
    """SELECT frame_id, i, j, round(CASE WHEN (i + j) % 3 <> 0 THEN i + (i % 5 - 2) / 1e1 ELSE ri END, 6) AS ri,
 round(CASE WHEN (i + j) % 3 <> 0 THEN j + (j % 7 - 3) / 1e1 ELSE rj END, 6) AS rj FROM refined""",
    ZERO,
)
def d4(spark, sf):
    offsets = view(spark, sf, "fx_cells").where("(i + j) % 3 <> 0").select(
        "frame_id", "i", "j", ((F.col("j") % 7 - 3) / F.lit(10.0)).alias("dx"), ((F.col("i") % 5 - 2) / F.lit(10.0)).alias("dy")
    )
    return refined(detect.refine_offset(peaks(spark, sf), offsets, ["frame_id"]))


CROP = """,
placed AS (SELECT *, 2e0 * rj + 5e-1 AS px, 2e0 * ri + 5e-1 AS py, CAST(frame_id % 7 AS DOUBLE) AS a FROM refined),
framed AS (SELECT *, (px / 128e0 + a * py / 1e3 + 1e-1) / (1e0 + a * px / 1e4) AS x, (py / 64e0 - a * px / 1e3 + 5e-2) / (1e0 + a * px / 1e4) AS y FROM placed)"""


def framed(spark, sf):
    a = (F.col("frame_id") % 7).cast("double")
    m = [F.lit(1.0) / 128.0, a / 1000.0, F.lit(0.1), -a / 1000.0, F.lit(1.0) / 64.0, F.lit(0.05), a / 10000.0, F.lit(0.0), F.lit(1.0)]
    return detect.peaks_to_frame(detect.refine_centroid(peaks(spark, sf)).withColumn("to_frame", F.array(*m)))


@query("d5_peaks_to_frame", ("fx_cells",), "SELECT frame_id, i, j, round(x, 6) AS x, round(y, 6) AS y FROM framed", ZERO + CROP)
def d5(spark, sf):
    return framed(spark, sf).select("frame_id", "i", "j", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "d6_assemble_peaks",
    ("fx_cells",),
    """SELECT frame_id, channel, i, j, round(value, 6) AS value FROM (SELECT CAST(floor(frame_id / 6) AS BIGINT) AS frame_id, frame_id % 6 AS channel, i, j, value,
 row_number() OVER (PARTITION BY frame_id ORDER BY value DESC, i, j) AS rn FROM peaks) p WHERE channel > 3 OR rn = 1""",
    PEAKS,
)
def d6(spark, sf):
    p = peaks(spark, sf).select(
        F.floor(F.col("frame_id") / 6).cast("bigint").alias("frame_id"), (F.col("frame_id") % 6).alias("channel"), "i", "j", "value"
    )
    return detect.assemble_peaks(p).select("frame_id", "channel", "i", "j", r6("value").alias("value"))


@query(
    "d7_coarse_quad",
    ("fx_fit_peaks",),
    """SELECT frame_id, pos, round((cx + ax * a + ox * c) / width, 6) AS x, round((cy + ay * a + oy * c) / height, 6) AS y FROM (
 SELECT *, CASE WHEN pos IN (0, 3) THEN first - (last - first) * 12e-2 ELSE last + (last - first) * 12e-2 END AS a,
  CASE WHEN pos >= 2 THEN front ELSE front + (((bx - cx) * ox + (by_ - cy) * oy) - front) / (1e0 - 62e-2) * 125e-2 END AS c
 FROM (SELECT s.*, e.first, e.last, (gx - cx) * ox + (gy - cy) * oy AS front FROM turned s JOIN ends e ON s.frame_id = e.frame_id) q
 CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS pos) k) z""",
    """pts AS (SELECT frame_id, channel, x * width AS px, y * height AS py, width, height FROM fx_fit_peaks WHERE channel <= 6),
sums AS (SELECT frame_id, max(width) AS width, max(height) AS height, avg(px) AS cx, avg(py) AS cy,
 avg(CASE WHEN channel = 4 THEN px END) AS gx, avg(CASE WHEN channel = 4 THEN py END) AS gy,
 avg(CASE WHEN channel IN (5, 6) THEN px END) AS bx, avg(CASE WHEN channel IN (5, 6) THEN py END) AS by_,
 count(*) AS n, count(CASE WHEN channel = 4 THEN 1 END) AS gaps, count(CASE WHEN channel IN (5, 6) THEN 1 END) AS blacks FROM pts GROUP BY 1),
moments AS (SELECT p.frame_id, sum((px - cx) * (px - cx)) AS xx, sum((px - cx) * (py - cy)) AS xy, sum((py - cy) * (py - cy)) AS yy
 FROM pts p JOIN sums s ON p.frame_id = s.frame_id WHERE gaps >= 4 AND n >= 8 AND blacks > 0 GROUP BY 1),
axes AS (SELECT s.*, cos(5e-1 * atan2(2e0 * xy, xx - yy)) AS ax0, sin(5e-1 * atan2(2e0 * xy, xx - yy)) AS ay0 FROM sums s JOIN moments m ON s.frame_id = m.frame_id),
flipped AS (SELECT *, CASE WHEN (bx - cx) * -ay0 + (by_ - cy) * ax0 < (gx - cx) * -ay0 + (gy - cy) * ax0 THEN -1 ELSE 1 END AS fl FROM axes),
turned AS (SELECT *, -ay0 * fl AS ox, ax0 * fl AS oy, CASE WHEN ax0 * ax0 * fl + ay0 * ay0 * fl > 0 THEN -ax0 ELSE ax0 END AS ax,
 CASE WHEN ax0 * ax0 * fl + ay0 * ay0 * fl > 0 THEN -ay0 ELSE ay0 END AS ay FROM flipped),
ends AS (SELECT p.frame_id, min((px - cx) * ax + (py - cy) * ay) AS first, max((px - cx) * ax + (py - cy) * ay) AS last
 FROM pts p JOIN turned t ON p.frame_id = t.frame_id GROUP BY 1)""",
)
def d7(spark, sf):
    quads = detect.coarse_quad(view(spark, sf, "fx_fit_peaks"))
    return quads.select("frame_id", F.posexplode("quad").alias("pos", "p")).select(
        "frame_id", "pos", r6("p.x").alias("x"), r6("p.y").alias("y")
    )


QUAD_SUMS = """
q AS (SELECT *, (x0 + x1 + x2 + x3) / 4e0 AS cx, (y0 + y1 + y2 + y3) / 4e0 AS cy, x1 - x0 + x2 - x3 AS dx, y1 - y0 + y2 - y3 AS dy FROM fx_quads),
u AS (SELECT *, dx / sqrt(dx * dx + dy * dy) AS ax, dy / sqrt(dx * dx + dy * dy) AS ay FROM q),
corners AS (SELECT *, CASE pos WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS x, CASE pos WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS y
 FROM u CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS pos) k)"""


def quads(spark, sf):
    return view(spark, sf, "fx_quads").select(
        "frame_id", G.quad("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3").alias("quad")
    )


@query(
    "d8_widen_quad",
    ("fx_quads",),
    """SELECT frame_id, pos, round(x + ax * ((x - cx) * ax + (y - cy) * ay) * (13e-1 - 1e0), 6) AS x,
 round(y + ay * ((x - cx) * ax + (y - cy) * ay) * (13e-1 - 1e0), 6) AS y FROM corners""",
    QUAD_SUMS,
)
def d8(spark, sf):
    return quads(spark, sf).select("frame_id", F.posexplode(detect.widen_quad("quad")).alias("pos", "p")).select(
        "frame_id", "pos", r6("p.x").alias("x"), r6("p.y").alias("y")
    )


@query(
    "d8_ends_inside",
    ("fx_quads",),
    """SELECT frame_id, CASE WHEN min(CASE WHEN px >= 768e0 * 2e-2 AND px <= 768e0 * (1e0 - 2e-2) THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS inside FROM (
 SELECT c.frame_id, 384e0 + (((c.x * 640e0 - 32e0) - e.cx) * e.ax + (c.y * 480e0 - e.cy) * e.ay) / e.scale AS px FROM corners c JOIN (
  SELECT frame_id, cx, cy, ax, ay, greatest(al * 116e-2 / 768e0, (ac + al * 116e-2 * 15e-2 / 116e-2) / 160e0, 1e-6) AS scale FROM (
   SELECT frame_id, max(cx) AS cx, max(cy) AS cy, max(ax) AS ax, max(ay) AS ay,
    max((px - cx) * ax + (py - cy) * ay) - min((px - cx) * ax + (py - cy) * ay) AS al,
    max((py - cy) * ax - (px - cx) * ay) - min((py - cy) * ax - (px - cx) * ay) AS ac
   FROM (SELECT frame_id, x * 640e0 AS px, y * 480e0 AS py, cx * 640e0 AS cx, cy * 480e0 AS cy,
    dx * 640e0 / sqrt(dx * dx * 409600e0 + dy * dy * 230400e0) AS ax, dy * 480e0 / sqrt(dx * dx * 409600e0 + dy * dy * 230400e0) AS ay FROM corners) s
   GROUP BY 1) t) e ON c.frame_id = e.frame_id) z GROUP BY 1""",
    QUAD_SUMS,
)
def d8_ends(spark, sf):
    px = F.transform("quad", lambda p: G.point(p["x"] * 640.0, p["y"] * 480.0))
    moved = F.transform("px", lambda p: G.point(p["x"] - 32.0, p["y"]))
    q = quads(spark, sf).withColumn("px", px).withColumn("crop", detect.crop_axes("px", 768, 160))
    return q.select("frame_id", detect.ends_inside(moved, "crop").cast("int").alias("inside"))


@query("d9_presence_gate", ("fx_frames",), "SELECT frame_id, round(presence, 6) AS presence FROM fx_frames WHERE presence >= 6e-1")
def d9(spark, sf):
    return detect.presence_gate(view(spark, sf, "fx_frames").select("frame_id", "presence")).select(
        "frame_id", r6("presence").alias("presence")
    )


LANDMARKS = """
marks AS (SELECT frame_id, channel % 2 AS hand, x / 64e1 + CAST(frame_id % 3 - 1 AS DOUBLE) / 2e0 AS x, y / 48e1 AS y FROM fx_points)"""


@query(
    "d10_hand_boxes",
    ("fx_points",),
    """SELECT frame_id, hand, round(x0 - (x1 - x0) * 2e-1, 9) AS x0, round(y0 - (y1 - y0) * 2e-1, 9) AS y0,
 round(x1 + (x1 - x0) * 2e-1, 9) AS x1, round(y1 + (y1 - y0) * 2e-1, 9) AS y1 FROM (
 SELECT frame_id, hand, least(1e0, min(x)) AS x0, least(1e0, min(y)) AS y0, greatest(0e0, max(x)) AS x1, greatest(0e0, max(y)) AS y1 FROM marks GROUP BY 1, 2) b""",
    LANDMARKS,
)
def d10(spark, sf):
    marks = view(spark, sf, "fx_points").select(
        "frame_id", (F.col("channel") % 2).alias("hand"),
        (F.col("x") / 640.0 + (F.col("frame_id") % 3 - 1).cast("double") / 2.0).alias("x"), (F.col("y") / 480.0).alias("y"),
    )
    return detect.hand_boxes(marks, 0.2).select("frame_id", "hand", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


MASK = """
mask AS (SELECT frame_id, i AS row_, j AS col_, (i * 7 + j * 3 + frame_id) % 5 AS category FROM fx_cells),
boxes AS (SELECT frame_id, hand, CAST((frame_id * 3 + hand * 5) % 10 - 1 AS DOUBLE) / 1e1 AS x0, CAST((frame_id * 7 + hand) % 6 AS DOUBLE) / 1e1 AS y0,
 CAST((frame_id * 3 + hand * 5) % 10 + 3 AS DOUBLE) / 1e1 AS x1, CAST((frame_id * 7 + hand) % 6 + 5 AS DOUBLE) / 1e1 AS y1
 FROM (SELECT DISTINCT frame_id FROM fx_cells WHERE frame_id % 5 <> 0) f CROSS JOIN (SELECT unnest([0, 1]) AS hand) h)"""


def mask(spark, sf):
    return view(spark, sf, "fx_cells").select(
        "frame_id", F.col("i").alias("row"), F.col("j").alias("col"),
        ((F.col("i") * 7 + F.col("j") * 3 + F.col("frame_id")) % 5).alias("category"),
    )


@query(
    "d11_skin_coverage",
    ("fx_cells",),
    """SELECT m.frame_id, m.cells, coalesce(k.kept, 0) AS kept, round(CAST(coalesce(k.kept, 0) AS DOUBLE) / m.cells, 6) AS coverage FROM
 (SELECT frame_id, count(*) AS cells FROM mask GROUP BY 1) m LEFT JOIN (SELECT m.frame_id, count(*) AS kept FROM mask m JOIN boxes b ON m.frame_id = b.frame_id
 AND col_ >= greatest(0, floor(x0 * 64e0)) AND col_ < least(64, ceil(x1 * 64e0)) AND row_ >= greatest(0, floor(y0 * 16e0)) AND row_ < least(16, ceil(y1 * 16e0))
 WHERE category = 2 GROUP BY 1) k ON m.frame_id = k.frame_id""",
    MASK,
)
def d11(spark, sf):
    f = F.col("frame_id")
    a, b = (f * 3 + F.col("hand") * 5) % 10, (f * 7 + F.col("hand")) % 6

    def tenth(c):
        return c.cast("double") / 10.0

    boxes = mask(spark, sf).where("frame_id % 5 <> 0").select("frame_id").distinct().select(
        "frame_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("hand")
    ).select("frame_id", "hand", tenth(a - 1).alias("x0"), tenth(b).alias("y0"), tenth(a + 3).alias("x1"), tenth(b + 5).alias("y1"))
    return detect.skin_coverage(mask(spark, sf), boxes, 64, 16).select("frame_id", "cells", "kept", r6("coverage").alias("coverage"))


@query("d12_occluders", ("fx_cells",), "SELECT frame_id, row_ AS row, col_ AS col, category FROM mask WHERE category IN (2, 4)", MASK)
def d12(spark, sf):
    return detect.occluders(mask(spark, sf))


def _mean_pool(batch):
    n, h, w, _ = batch.shape
    return batch[..., 0].astype("float64").reshape(n, 1, h // 2, 2, w // 2, 2).mean(axis=(3, 5))


@query(
    "d13_score_images",
    (),
    """SELECT vec_id AS frame_id, i, j, round(avg(v), 6) AS value FROM (SELECT vec_id, CAST(floor(floor(p / 8) / 2) AS INT) AS i, CAST(floor((p % 8) / 2) AS INT) AS j,
 CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings) e) x GROUP BY 1, 2, 3""",
)
def d13(spark, sf):
    images = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("frame_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("pixels")
    )
    rows = detect.score_images(images, _mean_pool, 1)
    return rows.select("frame_id", "i", F.posexplode("v").alias("j", "value")).select("frame_id", "i", "j", r6("value").alias("value"))
