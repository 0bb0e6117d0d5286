"""Queries of section F."""

from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions.quantiles import quantiles
from tonewheel.operators import evaluate
from tonewheel.plans.detection import quads
from tonewheel.plans.registry import query, r6
from tonewheel.sources.fixtures import view

MATCHES = """
labelled AS (SELECT l.frame_id, l.channel, l.idx, l.x, l.y, f.key_px, f.white_keys, f.elevation_deg,
 CASE WHEN l.channel <= 3 THEN 'corners' WHEN l.channel = 4 THEN 'gaps' ELSE 'black' END AS grp
 FROM fx_labels l JOIN fx_frames f ON l.frame_id = f.frame_id),
nearest AS (SELECT l.frame_id, l.channel, l.idx, min(sqrt((p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y)) / l.key_px) AS d
 FROM labelled l JOIN fx_peaks p ON l.frame_id = p.frame_id AND l.channel = p.channel GROUP BY 1, 2, 3),
matches AS (SELECT l.*, CASE WHEN n.d <= 5e-1 THEN n.d END AS e FROM labelled l
 LEFT JOIN nearest n ON l.frame_id = n.frame_id AND l.channel = n.channel AND l.idx = n.idx)"""

SCORE_COLS = """count(*) AS labels, round(CAST(count(e) AS DOUBLE) / count(*), 6) AS recall,
 round(quantile_cont(e, 0.5), 6) AS median_keys, round(avg(e), 6) AS mean_keys,
 round(coalesce(CAST(count(CASE WHEN e <= 1e-1 THEN 1 END) AS DOUBLE) / nullif(count(e), 0), 0), 6) AS pck_0_1,
 round(coalesce(CAST(count(CASE WHEN e <= 2.5e-1 THEN 1 END) AS DOUBLE) / nullif(count(e), 0), 0), 6) AS pck_0_25"""

VIEWS = ("fx_frames", "fx_labels", "fx_peaks")


def matches(spark, sf):
    frames = view(spark, sf, "fx_frames").select("frame_id", "key_px", "white_keys", "elevation_deg")
    labels = view(spark, sf, "fx_labels").join(frames, "frame_id")
    return evaluate.match_nearest(labels, view(spark, sf, "fx_peaks"))


def scored(df, *keys):
    return df.select(*keys, "labels", *[r6(c).alias(c) for c in ("recall", "median_keys", "mean_keys", "pck_0_1", "pck_0_25")])


@query("f1_match_nearest", VIEWS, "SELECT frame_id, channel, idx, round(e, 6) AS error_keys FROM matches", MATCHES)
def f1(spark, sf):
    return matches(spark, sf).select("frame_id", "channel", "idx", r6("error_keys").alias("error_keys"))


@query("f3_group_scores", VIEWS, f"SELECT grp, {SCORE_COLS} FROM matches GROUP BY grp", MATCHES)
def f3(spark, sf):
    return scored(evaluate.group_scores(matches(spark, sf)), "grp")


@query(
    "f2_key_width",
    ("fx_quads",),
    "SELECT frame_id, round(sqrt((x2 - x3) * (x2 - x3) + (y2 - y3) * (y2 - y3)) / (29 + frame_id % 24), 6) AS key_width FROM fx_quads",
)
def f2(spark, sf):
    q = quads(spark, sf)
    return q.select("frame_id", r6(evaluate.front_key_width("quad", F.lit(28) + F.col("frame_id") % 24)).alias("key_width"))


SCORABLE = MATCHES + """,
scorable AS (SELECT frame_id FROM fx_labels WHERE channel <= 3 GROUP BY 1 HAVING count(DISTINCT channel) = 4)"""


@query(
    "f4_failure_rate",
    VIEWS,
    """SELECT count(*) AS frames, round(avg(CAST(failed AS DOUBLE)), 6) AS failure_rate FROM (SELECT s.frame_id,
 CASE WHEN EXISTS (SELECT 1 FROM matches m WHERE m.frame_id = s.frame_id AND m.channel <= 3 AND m.e IS NULL) THEN 1 ELSE 0 END AS failed FROM scorable s) f""",
    SCORABLE,
)
def f4(spark, sf):
    frames = evaluate.scorable_frames(view(spark, sf, "fx_labels"))
    rate = evaluate.failure_rate(evaluate.frame_failures(matches(spark, sf), frames))
    return rate.select("frames", r6("failure_rate").alias("failure_rate"))


@query(
    "f5_score_by_view",
    VIEWS,
    f"""SELECT view, grp, {SCORE_COLS} FROM (SELECT m.*, unnest(['all', CAST(white_keys AS VARCHAR) || ' white keys',
 'elevation ' || CASE WHEN elevation_deg <= 3e1 THEN 'low' WHEN elevation_deg <= 6e1 THEN 'mid' ELSE 'high' END]) AS view FROM matches m) v GROUP BY view, grp""",
    MATCHES,
)
def f5(spark, sf):
    return scored(evaluate.score_by_view(matches(spark, sf)), "view", "grp")


GRIDS = """
grid AS (SELECT frame_id, i, j, value AS predicted, CASE (i * 13 + j * 7 + frame_id) % 41 WHEN 0 THEN 1e0 WHEN 1 THEN 9e-1 WHEN 2 THEN 5e-1 ELSE 0e0 END AS target,
 CASE WHEN (i + j) % 9 = 0 THEN 0e0 ELSE 1e0 END AS weight FROM fx_cells)"""

CELL_SCORES = GRIDS + """,
guess AS (SELECT c.frame_id, c.i, c.j FROM grid c WHERE c.predicted >= 2e-1 AND c.weight > 0 AND NOT EXISTS (SELECT 1 FROM grid n WHERE n.frame_id = c.frame_id
 AND abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND n.predicted > c.predicted)),
truth AS (SELECT c.frame_id, c.i, c.j FROM grid c WHERE c.target >= 8e-1 AND c.weight > 0 AND NOT EXISTS (SELECT 1 FROM grid n WHERE n.frame_id = c.frame_id
 AND abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND n.target > c.target)),
met AS (SELECT t.frame_id, t.i, t.j, min(sqrt(CAST((g.i - t.i) * (g.i - t.i) + (g.j - t.j) * (g.j - t.j) AS DOUBLE))) AS d FROM truth t JOIN guess g ON g.frame_id = t.frame_id GROUP BY 1, 2, 3),
frame_scores AS (SELECT f.frame_id, coalesce(g.n, 0) AS predictions, coalesce(t.n, 0) AS truths,
 coalesce(CAST(coalesce(m.hits, 0) AS DOUBLE) / g.n, 1e0) AS precision, coalesce(CAST(coalesce(m.hits, 0) AS DOUBLE) / t.n, 1e0) AS recall, coalesce(m.err, 0e0) AS error_px
 FROM (SELECT DISTINCT frame_id FROM grid) f LEFT JOIN (SELECT frame_id, count(*) AS n FROM guess GROUP BY 1) g ON f.frame_id = g.frame_id
 LEFT JOIN (SELECT frame_id, count(*) AS n FROM truth GROUP BY 1) t ON f.frame_id = t.frame_id
 LEFT JOIN (SELECT frame_id, count(*) AS hits, avg(d * 2e0) AS err FROM met WHERE d <= 15e-1 GROUP BY 1) m ON f.frame_id = m.frame_id)"""


def grid(spark, sf):
    i, j, f = F.col("i"), F.col("j"), F.col("frame_id")
    m = (i * 13 + j * 7 + f) % 41
    return view(spark, sf, "fx_cells").select(
        "frame_id", "i", "j", F.col("value").alias("predicted"),
        F.when(m == 0, 1.0).when(m == 1, 0.9).when(m == 2, 0.5).otherwise(0.0).alias("target"),
        F.when((i + j) % 9 == 0, 0.0).otherwise(1.0).alias("weight"),
    )


def frame_scores(spark, sf):
    return evaluate.score_cells(grid(spark, sf), 0.2, ("frame_id",))


@query(
    "f6_score_peaks",
    ("fx_cells",),
    "SELECT frame_id, predictions, truths, round(precision, 6) AS precision, round(recall, 6) AS recall, round(error_px, 6) AS error_px FROM frame_scores",
    CELL_SCORES,
)
def f6(spark, sf):
    return frame_scores(spark, sf).select("frame_id", "predictions", "truths", *[r6(c).alias(c) for c in ("precision", "recall", "error_px")])


@query(
    "f7_evaluate",
    ("fx_cells",),
    """SELECT count(*) AS frames, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(error_px), 6) AS error_px,
 round(avg(CASE WHEN (frame_id % 10 >= 5) = (frame_id % 3 >= 1) THEN 1e0 ELSE 0e0 END), 6) AS presence_accuracy FROM frame_scores""",
    CELL_SCORES,
)
def f7(spark, sf):
    scores = frame_scores(spark, sf)
    presence = view(spark, sf, "fx_heat_rows").select("frame_id").distinct().select(
        "frame_id", ((F.col("frame_id") % 10) / 10.0).alias("said"), F.when(F.col("frame_id") % 3 >= 1, 1.0).otherwise(0.0).alias("presence_target")
    )
    out = evaluate.evaluate_frames(scores, presence)
    return out.select("frames", *[r6(c).alias(c) for c in ("precision", "recall", "error_px", "presence_accuracy")])


def heat_cells(spark, sf):
    return grid(spark, sf).select(
        F.floor(F.col("frame_id") / 8).cast("bigint").alias("batch_id"), "frame_id", (F.col("frame_id") % 3).alias("channel"), "i", "j",
        (F.col("predicted") * 4.0).alias("logit"), "target", "weight",
    )


LOSS = GRIDS + """,
c AS (SELECT CAST(floor(frame_id / 8) AS BIGINT) AS batch_id, frame_id, frame_id % 3 AS channel, i, j, greatest(1e-4, least(1e0 - 1e-4, 1e0 / (1e0 + exp(-4e0 * predicted)))) AS p, target AS t, weight AS w FROM grid),
terms AS (SELECT batch_id, channel, CASE WHEN {peak} THEN -(1e0 - p) * (1e0 - p) * ln(p) ELSE -((1e0 - t) ** 4) * p * p * ln(1e0 - p) END * w AS loss, CASE WHEN {peak} THEN w ELSE 0e0 END AS pos FROM c),
per AS (SELECT batch_id, channel, sum(loss) / greatest(sum(pos), 1e0) AS l FROM terms GROUP BY 1, 2)"""
OWN = """(t >= 5e-1 AND NOT EXISTS (SELECT 1 FROM grid n WHERE n.frame_id = c.frame_id AND abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 AND n.target > c.t))"""


@query("f8_heat_loss", ("fx_cells",), "SELECT batch_id, round(avg(l), 6) AS heat_loss FROM per GROUP BY 1", LOSS.format(peak="t >= 8e-1"))
def f8(spark, sf):
    return evaluate.heat_loss(heat_cells(spark, sf)).select("batch_id", r6("heat_loss").alias("heat_loss"))


@query("f8_heat_loss_single", ("fx_cells",), "SELECT batch_id, round(avg(l), 6) AS heat_loss FROM per GROUP BY 1", LOSS.format(peak=OWN))
def f8_single(spark, sf):
    return evaluate.heat_loss(heat_cells(spark, sf), single_peak=True).select("batch_id", r6("heat_loss").alias("heat_loss"))


@query(
    "f8_offset_loss",
    ("fx_cells",),
    """SELECT CAST(floor(frame_id / 8) AS BIGINT) AS batch_id, round(sum((abs(predicted - 1e-1) + abs(predicted * 2e0 + 1e-1)) * weight) / greatest(sum(weight * 2e0), 1e0), 6) AS offset_loss
FROM grid GROUP BY 1""",
    GRIDS,
)
def f8_offset(spark, sf):
    p = F.col("predicted")
    cells = grid(spark, sf).select(
        F.floor(F.col("frame_id") / 8).cast("bigint").alias("batch_id"), p.alias("dx"), F.lit(0.1).alias("target_dx"),
        (p * 2.0).alias("dy"), F.lit(-0.1).alias("target_dy"), "weight",
    )
    return evaluate.offset_loss(cells).select("batch_id", r6("offset_loss").alias("offset_loss"))


# fits: one frame in six unfitted, one in seven on another board, one in three numbered off
FITS = """
fits AS (SELECT frame_id, CASE WHEN frame_id % 7 = 0 THEN 36 ELSE white_keys END AS white_keys, CASE WHEN frame_id % 7 = 0 THEN 'C' ELSE phase END AS phase,
 width, height, h0, h1, h2 + CAST(frame_id % 9 - 4 AS DOUBLE) / 4e3 AS h2, h3, h4, h5 + CAST(frame_id % 5 - 2 AS DOUBLE) / 2e3 AS h5, h6, h7, h8
 FROM fx_truth WHERE frame_id % 6 <> 0),
labels AS (SELECT frame_id, channel, ord + CASE WHEN channel = 4 AND frame_id % 3 = 0 THEN frame_id % 5 - 2 ELSE 0 END AS idx, x_px, y_px, width, height, white_keys AS label_keys
 FROM fx_drawn WHERE channel BETWEEN 2 AND 6 AND NOT (channel = 5 AND frame_id % 8 = 0 AND ord = 1)),
key AS (SELECT a.frame_id, sqrt((a.x_px - b.x_px) * (a.x_px - b.x_px) + (a.y_px - b.y_px) * (a.y_px - b.y_px)) / a.label_keys AS key_px
 FROM labels a JOIN labels b ON a.frame_id = b.frame_id AND a.channel = 2 AND b.channel = 3),
placed AS (SELECT f.frame_id, t.channel, t.ord, (h0 * t.x + h1 * t.y + h2) / (h6 * t.x + h7 * t.y + h8) * f.width AS fx,
 (h3 * t.x + h4 * t.y + h5) / (h6 * t.x + h7 * t.y + h8) * f.height AS fy FROM fits f JOIN fx_template t ON f.white_keys = t.white_keys AND f.phase = t.phase WHERE t.channel BETWEEN 2 AND 6),
errs AS (SELECT p.frame_id, CASE WHEN p.channel = 4 THEN 'gap' WHEN p.channel >= 5 THEN 'black' ELSE 'corner' END AS part, s.shift,
 sqrt((fx - x_px) * (fx - x_px) + (fy - y_px) * (fy - y_px)) / key_px AS e FROM placed p CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS shift) s
 JOIN labels l ON p.frame_id = l.frame_id AND p.channel = l.channel AND l.idx = p.ord + s.shift JOIN key k ON k.frame_id = p.frame_id WHERE p.channel = 4 OR s.shift = 0),
meds AS (SELECT frame_id, part, shift, list_sort(list(e))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS m FROM errs GROUP BY 1, 2, 3),
best AS (SELECT frame_id, arg_min(shift, m * 1e0 + shift * 1e-15) AS shift FROM meds WHERE part = 'gap' GROUP BY 1),
blacks AS (SELECT frame_id, count(*) AS n FROM labels WHERE channel >= 5 GROUP BY 1),
fit_blacks AS (SELECT white_keys, phase, count(*) AS n FROM fx_template WHERE channel IN (5, 6) GROUP BY 1, 2),
checks AS (SELECT t.frame_id, CASE WHEN f.frame_id IS NULL THEN 0 ELSE 1 END AS acquired, CAST(f.white_keys AS VARCHAR) || f.phase AS board,
 CASE WHEN f.white_keys = t.white_keys THEN 1 ELSE 0 END AS right_board, CASE WHEN f.white_keys = t.white_keys THEN coalesce(b.shift, -2) END AS shift,
 CASE WHEN f.white_keys = t.white_keys THEN g.m END AS gap_keys, CASE WHEN fb.n = bl.n THEN k.m END AS black_keys, c.m AS corner_keys
 FROM fx_truth t LEFT JOIN fits f ON t.frame_id = f.frame_id LEFT JOIN best b ON b.frame_id = f.frame_id
 LEFT JOIN meds g ON g.frame_id = f.frame_id AND g.part = 'gap' AND g.shift = 0 LEFT JOIN meds k ON k.frame_id = f.frame_id AND k.part = 'black'
 LEFT JOIN meds c ON c.frame_id = f.frame_id AND c.part = 'corner' LEFT JOIN fit_blacks fb ON fb.white_keys = f.white_keys AND fb.phase = f.phase
 LEFT JOIN blacks bl ON bl.frame_id = f.frame_id)"""
FIT_VIEWS = ("fx_truth", "fx_drawn", "fx_template")


def truth_fits(spark, sf):
    """The planted fits, some moved a little, some on another board, some missing."""
    t = view(spark, sf, "fx_truth")
    f = F.col("frame_id")
    h = [F.col(f"h{i}") for i in range(9)]
    h[2] = h[2] + (f % 9 - 4).cast("double") / 4000.0
    h[5] = h[5] + (f % 5 - 2).cast("double") / 2000.0
    other = f % 7 == 0
    return t.where(f % 6 != 0).select(
        "frame_id", F.when(other, 36).otherwise(F.col("white_keys")).alias("white_keys"),
        F.when(other, "C").otherwise(F.col("phase")).alias("phase"), F.array(*h).alias("homography"),
    )


def fit_checks(spark, sf):
    drawn = view(spark, sf, "fx_drawn").where(F.col("channel").between(2, 6))
    drawn = drawn.where(~((F.col("channel") == 5) & (F.col("frame_id") % 8 == 0) & (F.col("ord") == 1)))
    off = F.when((F.col("channel") == 4) & (F.col("frame_id") % 3 == 0), F.col("frame_id") % 5 - 2).otherwise(0)
    end = F.struct("x_px", "y_px")
    key = drawn.where(F.col("channel") <= 3).groupBy("frame_id").agg(
        F.max(F.when(F.col("channel") == 2, end)).alias("a"), F.max(F.when(F.col("channel") == 3, end)).alias("b"), F.max("white_keys").alias("n")
    ).select("frame_id", (G.length(F.col("a.x_px") - F.col("b.x_px"), F.col("a.y_px") - F.col("b.y_px")) / F.col("n")).alias("key_px"))
    labels = drawn.select(
        "frame_id", "channel", (F.col("ord") + off).alias("idx"), "x_px", "y_px", "width", "height"
    ).join(key, "frame_id")
    frames = view(spark, sf, "fx_truth").select("frame_id", F.col("white_keys").alias("label_keys"))
    blacks = drawn.where(F.col("channel") >= 5).groupBy("frame_id").agg(F.count(F.lit(1)).alias("label_blacks"))
    return evaluate.check_fit(truth_fits(spark, sf), labels, frames, blacks)


@query(
    "f9_check_fit",
    FIT_VIEWS,
    """SELECT frame_id, acquired, board, right_board, CAST(shift AS INT) AS shift, round(gap_keys, 6) AS gap_keys, round(black_keys, 6) AS black_keys, round(corner_keys, 6) AS corner_keys FROM checks""",
    FITS,
)
def f9(spark, sf):
    return fit_checks(spark, sf).select(
        "frame_id", F.col("acquired").cast("int").alias("acquired"), "board", F.col("right_board").cast("int").alias("right_board"), "shift",
        *[r6(c).alias(c) for c in ("gap_keys", "black_keys", "corner_keys")],
    )


@query(
    "f10_summarise_fits",
    FIT_VIEWS,
    """SELECT (SELECT count(*) FROM checks) AS frames, (SELECT floor(avg(CAST(acquired AS DOUBLE)) * 1e2 + 5e-1) / 1e2 FROM checks) AS acquired,
 (SELECT floor(avg(CAST(right_board AS DOUBLE)) * 1e2 + 5e-1) / 1e2 FROM checks) AS right_board,
 (SELECT floor(avg(CASE WHEN shift = 0 THEN 1e0 ELSE 0e0 END) * 1e2 + 5e-1) / 1e2 FROM checks) AS right_numbering,
 """ + ",\n ".join(
        f"(SELECT floor(list_sort(list({c}))[CAST(floor(count({c}) / 2) AS BIGINT) + 1] * 1e3 + 5e-1) / 1e3 FROM checks WHERE shift = 0 AND {c} IS NOT NULL) AS {c}"
        for c in ("gap_keys", "black_keys", "corner_keys")
    ),
    FITS,
)
def f10(spark, sf):
    return evaluate.summarise_fits(fit_checks(spark, sf))


@query(
    "f11_acquisition_audit",
    ("fx_frames",),
    """SELECT video, count(*) AS frames, count(CASE WHEN fitted THEN 1 END) AS fitted, count(CASE WHEN acq THEN 1 END) AS acquisitions,
 count(CASE WHEN acq AND mirrored THEN 1 END) AS backwards, count(CASE WHEN fitted AND mirrored THEN 1 END) AS mirrored FROM (
 SELECT *, fitted AND NOT coalesce(lag(fitted) OVER (PARTITION BY video, floor(frame_index / 4) ORDER BY frame_index), false) AS acq FROM (
  SELECT clip_id AS video, frame_index, presence >= 4e-1 AS fitted, frame_id % 5 = 0 AS mirrored FROM fx_frames) f) g GROUP BY ROLLUP (video)""",
)
def f11(spark, sf):
    frames = view(spark, sf, "fx_frames").select(
        F.col("clip_id").alias("video"), "frame_index", (F.col("presence") >= 0.4).alias("fitted"), (F.col("frame_id") % 5 == 0).alias("mirrored")
    )
    return evaluate.acquisition_audit(frames, 4)


@query(
    "f12_back_edge",
    FIT_VIEWS,
    """SELECT case_color, count(*) AS backs, round(list_sort(list(a))[least(CAST(floor(count(*) * 5e-1) AS BIGINT), count(*) - 1) + 1], 6) AS ahead_median,
 round(list_sort(list(abs(a)))[least(CAST(floor(count(*) * 5e-1) AS BIGINT), count(*) - 1) + 1], 6) AS off_median,
 round(list_sort(list(abs(a)))[least(CAST(floor(count(*) * 9e-1) AS BIGINT), count(*) - 1) + 1], 6) AS off_p90
FROM (SELECT unnest(['all', coalesce(cc, 'unnamed')]) AS case_color, a FROM dist) d GROUP BY 1""",
    """b AS (SELECT d.frame_id, CASE d.frame_id % 4 WHEN 0 THEN 'black' WHEN 1 THEN 'silver' WHEN 2 THEN 'wood' END AS cc, d.x_px / d.width AS x, d.y_px / d.height + CAST(d.ord % 7 - 3 AS DOUBLE) / 1e2 AS y
 FROM fx_drawn d WHERE channel = 9),
f AS (SELECT *, CAST(frame_id % 5 - 2 AS DOUBLE) / 5e1 AS k, width / CAST(height AS DOUBLE) AS asp FROM fx_truth),
s AS (SELECT f.*, b.cc, b.x, b.y, (b.x - 5e-1) * asp AS dx, b.y - 5e-1 AS dy FROM b JOIN f ON b.frame_id = f.frame_id WHERE b.x >= 2e-2 AND b.x < 98e-2 AND b.y >= 2e-2 AND b.y < 98e-2),
s2 AS (SELECT *, 5e-1 + dx / (1e0 + k * (dx * dx + dy * dy) / ((asp * asp + 1e0) / 4e0)) / asp AS sx, 5e-1 + dy / (1e0 + k * (dx * dx + dy * dy) / ((asp * asp + 1e0) / 4e0)) AS sy,
 h4 * h8 - h5 * h7 AS c00, h5 * h6 - h3 * h8 AS c01, h3 * h7 - h4 * h6 AS c02, h2 * h7 - h1 * h8 AS c10, h0 * h8 - h2 * h6 AS c11, h1 * h6 - h0 * h7 AS c12,
 h1 * h5 - h2 * h4 AS c20, h2 * h3 - h0 * h5 AS c21, h0 * h4 - h1 * h3 AS c22 FROM s),
s3 AS (SELECT *, (c00 * sx + c10 * sy + c20) / (c02 * sx + c12 * sy + c22) AS ox, (c01 * sx + c11 * sy + c21) / (c02 * sx + c12 * sy + c22) AS oy FROM s2),
s4 AS (SELECT *, (h0 * ox + h2) / (h6 * ox + h8) AS ex, (h3 * ox + h5) / (h6 * ox + h8) AS ey, sqrt(asp * asp + 1e0) / 2e0 AS reach FROM s3 WHERE ox >= 0 AND ox <= white_keys AND abs(oy) <= 5e-1),
s5 AS (SELECT *, (ex - 5e-1) * asp / reach AS qx, (ey - 5e-1) / reach AS qy FROM s4),
s6 AS (SELECT *, sqrt(qx * qx + qy * qy) AS sr FROM s5),
s7 AS (SELECT *, CASE WHEN abs(k) < 1e-12 OR sr < 1e-12 OR 1e0 - 4e0 * k * sr * sr < 0 THEN 1e0 ELSE (1e0 - sqrt(1e0 - 4e0 * k * sr * sr)) / (2e0 * k * sr) / sr END AS sc FROM s6),
dist AS (SELECT cc, -sign(oy) * sqrt(((5e-1 + qx * sc * reach / asp - x) * width) ** 2 + ((5e-1 + qy * sc * reach - y) * height) ** 2) AS a FROM s7)""",
)
def f12(spark, sf):
    f = F.col("frame_id")
    backs = view(spark, sf, "fx_drawn").where("channel = 9").select(
        "frame_id", F.when(f % 4 == 0, "black").when(f % 4 == 1, "silver").when(f % 4 == 2, "wood").alias("case_color"),
        (F.col("x_px") / F.col("width")).alias("x"), (F.col("y_px") / F.col("height") + (F.col("ord") % 7 - 3).cast("double") / 100.0).alias("y"),
    )
    fits = view(spark, sf, "fx_truth").select(
        "frame_id", "white_keys", "width", "height", F.array(*[f"h{i}" for i in range(9)]).alias("homography"),
        ((f % 5 - 2).cast("double") / 50.0).alias("lens_k"), (F.col("width") / F.col("height").cast("double")).alias("lens_aspect"),
    )
    report = evaluate.back_edge_report(evaluate.back_edge_distances(backs, fits))
    return report.select("case_color", "backs", *[r6(c).alias(c) for c in ("ahead_median", "off_median", "off_p90")])


@query(
    "f13_end_for_end",
    ("fx_quads",),
    """SELECT count(CASE WHEN frame_id % 3 <> 0 THEN 1 END) AS fitted, count(CASE WHEN frame_id % 3 = 1 AND (c < 0) <> (r < 0) THEN 1 END) AS end_for_end FROM (
 SELECT frame_id, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS c, (x0 - x1) * (y3 - y1) - (y0 - y1) * (x3 - x1) AS r FROM fx_quads) q""",
)
def f13(spark, sf):
    q, f = quads(spark, sf), F.col("frame_id")
    p = G.corners_of("quad")
    frames = q.select(
        F.col("quad").alias("label_quad"),
        F.when(f % 3 == 1, F.array(p[1], p[0], p[3], p[2])).when(f % 3 == 2, F.col("quad")).alias("fit_quad"),
    )
    return evaluate.end_for_end(frames)


@query(
    "f14_latency",
    (),
    """SELECT l_returnflag AS clip, count(*) AS frames, round(avg(CASE WHEN l_linenumber <= 5 THEN 1e0 ELSE 0e0 END) * 1e2, 6) AS tracked_pct,
 list_sort(list(l_extendedprice))[CAST(ceil(count(*) * 5e-1) AS BIGINT)] AS median_ms, list_sort(list(l_extendedprice))[CAST(ceil(count(*) * 95e-2) AS BIGINT)] AS p95_ms FROM lineitem GROUP BY 1""",
)
def f14(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_returnflag").alias("clip"), (F.col("l_linenumber") <= 5).alias("tracked"), F.col("l_extendedprice").alias("process_ms")
    )
    out = evaluate.latency_summary(lines, ["clip"])
    return out.select("clip", "frames", r6("tracked_pct").alias("tracked_pct"), "median_ms", "p95_ms")


def score_docs(spark, sf):
    """A nested score document per supplier."""
    k = F.col("s_suppkey")
    gaps = F.struct((k % 40).alias("labels"), ((k % 9) / F.lit(8.0)).alias("recall"), F.struct(((k % 5) / F.lit(4.0)).alias("0.1")).alias("pck"))
    doc = F.to_json(F.struct(F.col("s_nationkey").alias("frames"), ((k % 16) / F.lit(16.0)).alias("failure_rate"), F.lit(True).alias("ok"), F.struct(gaps.alias("gaps")).alias("groups")))
    entry = F.concat(F.when(k % 2 == 0, "model-a").otherwise("model-b"), F.lit(" centroid"), F.when(k % 3 == 0, "").when(k % 3 == 1, " 52 white keys").otherwise(" elevation low"))
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("run"), entry.alias("entry"), F.parse_json(doc).alias("score"))


METRICS = """
metrics AS (SELECT s_suppkey AS run, s_suppkey % 2 AS m, s_suppkey % 3 AS v, unnest(['frames', 'failure_rate', 'groups/gaps/labels', 'groups/gaps/recall', 'groups/gaps/pck/0.1']) AS path,
 unnest([CAST(s_nationkey AS DOUBLE), (s_suppkey % 16) / 16e0, CAST(s_suppkey % 40 AS DOUBLE), (s_suppkey % 9) / 8e0, (s_suppkey % 5) / 4e0]) AS value FROM supplier)"""


@query("f21_flatten_metrics", (), "SELECT run, path, round(value, 6) AS value FROM metrics", METRICS)
def f21(spark, sf):
    return evaluate.flatten_metrics(score_docs(spark, sf).drop("entry")).select("run", "path", r6("value").alias("value"))


@query(
    "f22_model_metrics",
    (),
    """SELECT run, 'clips/' || CASE v WHEN 0 THEN '' WHEN 1 THEN '52 white keys/' ELSE 'elevation low/' END || path AS path, round(value, 6) AS value FROM metrics WHERE m = 0""",
    METRICS,
)
def f22(spark, sf):
    return evaluate.model_metrics(score_docs(spark, sf), "model-a", "clips").select("run", "path", r6("value").alias("value"))


RULES = {"interp": (0.9, "interp"), "lower": (0.9, "lower"), "rank_": (0.95, "rank"), "trunc_": (0.9, "trunc"), "upper_": (0.5, "upper")}


@query(
    "f23_quantiles",
    (),
    """SELECT y AS l_shipdate_year, round(qc, 6) AS interp, s[CAST(floor(9e-1 * (n - 1)) AS BIGINT) + 1] AS lower,
 s[CAST(ceil(n * 95e-2) AS BIGINT)] AS rank_, s[least(CAST(floor(n * 9e-1) AS BIGINT), n - 1) + 1] AS trunc_, s[CAST(floor(n / 2) AS BIGINT) + 1] AS upper_
FROM (SELECT CAST(year(l_shipdate) AS INT) AS y, list_sort(list(l_extendedprice - 5e4)) AS s, count(*) AS n, quantile_cont(l_extendedprice - 5e4, 0.9) AS qc FROM lineitem GROUP BY 1) b""",
)
def f23(spark, sf):
    prices = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.year("l_shipdate").alias("l_shipdate_year"), (F.col("l_extendedprice") - 50000.0).alias("price")
    )
    out = quantiles(prices, "price", RULES, ["l_shipdate_year"])
    return out.select("l_shipdate_year", r6("interp").alias("interp"), "lower", "rank_", "trunc_", "upper_")
