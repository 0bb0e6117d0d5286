"""Queries of section E."""

from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions import picks
from tonewheel.functions.lineage import cut
from tonewheel.operators import fit
from tonewheel.plans.registry import query, r6
from tonewheel.sources.fixtures import view

H9 = [f"h{i}" for i in range(9)]


def peaks(spark, sf):
    return view(spark, sf, "fx_fit_peaks").select("frame_id", F.col("channel").cast("int").alias("channel"), F.col("ord").cast("bigint").alias("ord"), "x", "y", "score")


def truth(spark, sf):
    return view(spark, sf, "fx_truth").withColumn("homography", F.array(*H9))


def frames(spark, sf):
    return view(spark, sf, "fx_boards").select("frame_id", "width", "height")


def prior_plan(spark, sf):
    """Every frame locked to its own board, with its planted fit as the prior."""
    t = truth(spark, sf)
    return fit.candidate_plan(frames(spark, sf), t.select("frame_id", "white_keys", "phase"), t.select("frame_id", "white_keys", "phase", "homography"))


def corner_plan(spark, sf):
    """Every frame locked to its own board without a prior."""
    t = truth(spark, sf).select("frame_id", "white_keys", "phase", "homography")
    return fit.candidate_plan(frames(spark, sf), t.select("frame_id", "white_keys", "phase"), t.where("1 = 0"))


@query(
    "e1_candidates",
    ("fx_truth",),
    """SELECT frame_id, CAST(cand AS INT) AS cand, white_keys, phase, shift, prior FROM (
 SELECT f.frame_id, b.n * 5 + s.n AS cand, b.white_keys, b.phase, s.shift, 0 AS prior FROM fx_truth f CROSS JOIN
  (SELECT 0 AS n, 29 AS white_keys, 'C' AS phase UNION ALL SELECT 1, 36, 'C' UNION ALL SELECT 2, 45, 'E' UNION ALL SELECT 3, 52, 'A') b CROSS JOIN
  (SELECT 0 AS n, 0 AS shift UNION ALL SELECT 1, -1 UNION ALL SELECT 2, 1 UNION ALL SELECT 3, -2 UNION ALL SELECT 4, 2) s WHERE f.frame_id % 3 = 0
 UNION ALL SELECT frame_id, 0, white_keys, phase, 0, CASE WHEN frame_id % 3 = 1 AND frame_id % 4 = 1 THEN 1 ELSE 0 END FROM fx_truth WHERE frame_id % 3 <> 0) c""",
)
def e1(spark, sf):
    t = truth(spark, sf)
    locks = t.where("frame_id % 3 <> 0").select("frame_id", "white_keys", "phase")
    priors = t.where("frame_id % 3 <> 2").select("frame_id", F.when(F.col("frame_id") % 4 == 1, F.col("white_keys")).otherwise(30).alias("white_keys"), "phase", "homography")
    plan = fit.candidate_plan(frames(spark, sf), locks, priors)
    return plan.select("frame_id", "cand", "white_keys", "phase", "shift", F.col("prior_inverse").isNotNull().cast("int").alias("prior"))


def _det3_sql(rows) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _estimator_sql() -> str:
    """Four corners by the inverse of their homography, three by Cramer's rule."""
    normal, rhs = [["xx", "xy", "sx"], ["xy", "yy", "sy"], ["sx", "sy", "m"]], ["bx", "by_", "b"]
    det = _det3_sql(normal)
    affine = [f"CASE WHEN m >= 3 AND {det} <> 0 THEN {_det3_sql([[rhs[r] if c == k else normal[r][c] for c in range(3)] for r in range(3)])} / {det} END" for k in range(3)]
    affine += [f"CASE WHEN m >= 3 AND {det} <> 0 THEN {v} END" for v in ("0e0", "0e0", "1e0")]
    exact = [f"CASE WHEN abs(hdet) > 1e-12 THEN ({v}) / hdet END" for v in (
        "h4 - h5 * h7", "h2 * h7 - h1", "h1 * h5 - h2 * h4", "h3 * h7 - h4 * h6", "h1 * h6 - h0 * h7", "h0 * h4 - h1 * h3")]
    sums = {"xx": "x{i} * x{i}", "xy": "x{i} * y{i}", "sx": "x{i}", "yy": "y{i} * y{i}", "sy": "y{i}", "m": "1e0", "bx": "x{i} * t{i}", "by_": "y{i} * t{i}", "b": "t{i}"}
    each = ", ".join(" + ".join(f"CASE WHEN x{i} IS NOT NULL THEN {t.format(i=i)} ELSE 0e0 END" for i in range(4)) + f" AS {k}" for k, t in sums.items())
    corner = ", ".join(f"max(CASE WHEN channel = {c} THEN {v} END) AS c{c}{v}" for c in range(4) for v in "xy")
    return f"""
crow AS (SELECT frame_id, {corner}, count(CASE WHEN channel = 4 THEN 1 END) AS n_gaps, count(CASE WHEN channel IN (5, 6) THEN 1 END) AS n_blacks, count(CASE WHEN channel <= 3 THEN 1 END) AS n_corners
 FROM fx_fit_peaks GROUP BY 1),
fronts AS (SELECT frame_id, e, CASE WHEN e = 0 THEN c3x ELSE c2x END AS fx, CASE WHEN e = 0 THEN c3y ELSE c2y END AS fy FROM crow CROSS JOIN (SELECT unnest([0, 1]) AS e) s
 WHERE c2x IS NOT NULL AND c3x IS NOT NULL AND (c0x IS NULL OR c1x IS NULL) AND n_gaps >= 6 AND n_blacks >= 6),
near_gaps AS MATERIALIZED (SELECT * FROM (SELECT f.frame_id, f.e, g.x AS gx, g.y AS gy, row_number() OVER (PARTITION BY f.frame_id, f.e ORDER BY sqrt((g.x - fx)**2 + (g.y - fy)**2), g.ord) AS k
 FROM fronts f JOIN fx_fit_peaks g ON g.frame_id = f.frame_id AND g.channel = 4) r WHERE k <= 4),
behind AS (SELECT frame_id, e, avg(ox / (1e0 - 62e-2)) AS ux, avg(oy / (1e0 - 62e-2)) AS uy FROM (
 SELECT n.frame_id, n.e, n.k, b.x - gx AS ox, b.y - gy AS oy, row_number() OVER (PARTITION BY n.frame_id, n.e, n.k ORDER BY sqrt((b.x - gx)**2 + (b.y - gy)**2), b.channel, b.ord) AS r
 FROM near_gaps n JOIN fx_fit_peaks b ON b.frame_id = n.frame_id AND b.channel IN (5, 6)) o WHERE r = 1 GROUP BY 1, 2),
filled AS (SELECT c.frame_id, coalesce(c0x, c3x + l.ux) AS x0, coalesce(c0y, c3y + l.uy) AS y0, coalesce(c1x, c2x + h.ux) AS x1, coalesce(c1y, c2y + h.uy) AS y1, c2x AS x2, c2y AS y2, c3x AS x3, c3y AS y3
 FROM crow c LEFT JOIN behind l ON l.frame_id = c.frame_id AND l.e = 0 LEFT JOIN behind h ON h.frame_id = c.frame_id AND h.e = 1 WHERE n_corners > 0),
onboard AS (SELECT f.*, t.white_keys, t.phase, CAST(t.white_keys AS DOUBLE) AS n, 0e0 AS t0, CAST(t.white_keys AS DOUBLE) AS t1, CAST(t.white_keys AS DOUBLE) AS t2, 0e0 AS t3,
 (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det, x0 - x1 + x2 - x3 AS qx, y0 - y1 + y2 - y3 AS qy FROM filled f JOIN fx_truth t ON t.frame_id = f.frame_id),
gh AS (SELECT *, {each}, CASE WHEN det <> 0 THEN (qx * (y3 - y2) - (x3 - x2) * qy) / det END AS g, CASE WHEN det <> 0 THEN ((x1 - x2) * qy - qx * (y1 - y2)) / det END AS h7 FROM onboard),
hom AS (SELECT *, (x1 - x0 + g * x1) / n AS h0, x3 - x0 + h7 * x3 AS h1, x0 AS h2, (y1 - y0 + g * y1) / n AS h3, y3 - y0 + h7 * y3 AS h4, y0 AS h5, g / n AS h6 FROM gh),
solved AS (SELECT *, h0 * (h4 - h5 * h7) + h1 * (h5 * h6 - h3) + h2 * (h3 * h7 - h4 * h6) AS hdet FROM hom),
estimated AS (SELECT frame_id, white_keys, phase, {", ".join(f"coalesce({x}, {f}) AS e{i}" for i, (x, f) in enumerate(zip(exact, affine)))} FROM solved)"""


@query(
    "e2_x_estimator", ("fx_truth", "fx_fit_peaks"),
    "SELECT frame_id, white_keys, phase, " + ", ".join(f"round(e{i}, 4) AS e{i}" for i in range(6)) + " FROM estimated", _estimator_sql(),
)
def e2(spark, sf):
    plan = corner_plan(spark, sf)
    corners = fit.complete_corners(peaks(spark, sf))
    est = fit.corner_estimators(plan.select("frame_id", "white_keys", "phase").join(corners, "frame_id"))
    return est.select("frame_id", "white_keys", "phase", *[F.round(G.at("est", i), 4).alias(f"e{i}") for i in range(6)])


def _map_sql(name: str, source: str) -> str:
    """The projective map from key index to place on the edge, from the points of `source`."""
    rows = [["a", "b", "c"], ["b", "d", "e"], ["c", "e", "f"]]
    rhs = ["u", "v", "w"]
    det = _det3_sql(rows)
    p, q, r = (f"{_det3_sql([[rhs[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)])} / {det}" for k in range(3))
    return f"""{name}_sums AS (SELECT frame_id, white_keys, start, CAST(count(*) AS DOUBLE) AS n, CAST(white_keys AS DOUBLE) AS k, sum(i * i) AS ii, sum(i) AS si, sum(i * i * t) AS iit, sum(i * t) AS it, sum(i * i * t * t) AS iitt,
 sum(t) AS st, sum(i * t * t) AS itt FROM {source} GROUP BY 1, 2, 3 HAVING count(*) >= 6),
{name}_m AS (SELECT frame_id, white_keys, start, ii + n * k * k AS a, si + n * k AS b, -iit - n * k * k AS c, n * 3e0 AS d, -it - n * k AS e, iitt + n * k * k AS f, it + n * k AS u, st + n AS v, -itt - n * k AS w FROM {name}_sums),
{name} AS MATERIALIZED (SELECT frame_id, white_keys, start, {p} AS p, {q} AS q, {r} AS r FROM {name}_m WHERE {det} <> 0)"""


def _numbered_sql(name: str, maps: str) -> str:
    return f"""{name}_at AS (SELECT m.frame_id, m.white_keys, m.start, g.ord, g.t, (g.t - q) / (p - r * g.t) AS exact FROM {maps} m JOIN edge g ON g.frame_id = m.frame_id WHERE p - r * g.t <> 0),
{name} AS MATERIALIZED (SELECT *, floor(exact + 5e-1) AS i, abs(exact - floor(exact + 5e-1)) AS error FROM {name}_at
 WHERE floor(exact + 5e-1) >= 1 AND floor(exact + 5e-1) < white_keys AND abs(exact - floor(exact + 5e-1)) < 3e-1)"""


COUNTED = _estimator_sql() + """,
placed AS (SELECT p.frame_id, p.ord, p.x, p.y, ((p.x - c3x) * (c2x - c3x) + (p.y - c3y) * (c2y - c3y)) / ((c2x - c3x)**2 + (c2y - c3y)**2) AS t,
 abs((p.x - c3x) * (c2y - c3y) - (p.y - c3y) * (c2x - c3x)) / sqrt((c2x - c3x)**2 + (c2y - c3y)**2) AS off, sqrt((c2x - c3x)**2 + (c2y - c3y)**2) AS len
 FROM fx_fit_peaks p JOIN crow c ON c.frame_id = p.frame_id WHERE p.channel = 4 AND c2x IS NOT NULL AND c3x IS NOT NULL),
edge AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n_edge FROM placed WHERE off < len * 3e-2 AND t > 0 AND t < 1) e WHERE n_edge >= 6),
lists AS MATERIALIZED (SELECT frame_id, list_sort(list(t)) AS ts FROM edge GROUP BY 1),
spaced AS (SELECT frame_id, ts, list_sort([ts[2] - ts[1], ts[3] - ts[2], ts[4] - ts[3], ts[5] - ts[4], ts[6] - ts[5]])[3] AS s FROM lists),
steps AS (SELECT frame_id, CAST(1 AS BIGINT) AS pos, ts, s AS spacing, ts[1] AS last, greatest(floor(ts[1] / s + 5e-1), 1e0) AS i, 1 AS took FROM spaced WHERE s > 0 /*recursive*/
 UNION ALL SELECT frame_id, pos + 1, ts, CASE WHEN ts[pos + 1] - last < 6e-1 * spacing THEN spacing ELSE (spacing + (ts[pos + 1] - last) / greatest(floor((ts[pos + 1] - last) / spacing + 5e-1), 1e0)) / 2e0 END,
  CASE WHEN ts[pos + 1] - last < 6e-1 * spacing THEN last ELSE ts[pos + 1] END,
  CASE WHEN ts[pos + 1] - last < 6e-1 * spacing THEN i ELSE i + greatest(floor((ts[pos + 1] - last) / spacing + 5e-1), 1e0) END, CASE WHEN ts[pos + 1] - last < 6e-1 * spacing THEN 0 ELSE 1 END
 FROM steps WHERE pos < len(ts)),
taken AS (SELECT frame_id, last AS t, i, row_number() OVER (PARTITION BY frame_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM steps WHERE took = 1),
guesses AS (SELECT e.frame_id, s.white_keys, e.t, (e0 * e.x + e1 * e.y + e2) / (e3 * e.x + e4 * e.y + e5) AS g FROM edge e JOIN estimated s ON s.frame_id = e.frame_id WHERE e0 IS NOT NULL),
started AS (SELECT k.frame_id, s.white_keys, 0 AS start, k.t, k.i FROM taken k JOIN estimated s ON s.frame_id = k.frame_id WHERE k.k < ceil(k.n / 2e0)
 UNION ALL SELECT frame_id, white_keys, 1, t, floor(g + 5e-1) FROM guesses WHERE abs(g - floor(g + 5e-1)) < 3e-1),
""" + ",\n".join([
    _map_sql("map_one", "started"), _numbered_sql("one", "map_one"), _map_sql("map_two", "one"), _numbered_sql("two", "map_two"),
]) + """,
kept AS (SELECT * FROM two UNION ALL SELECT o.* FROM one o WHERE NOT EXISTS (SELECT 1 FROM map_two m WHERE m.frame_id = o.frame_id AND m.start = o.start)),
best AS (SELECT frame_id, start FROM (SELECT frame_id, start, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, avg(error), start) AS r FROM kept GROUP BY 1, 2) b WHERE r = 1)"""


@query(
    "e3_count_gaps", ("fx_truth", "fx_fit_peaks"),
    """SELECT k.frame_id, k.white_keys, t.phase, k.ord, CAST(k.i AS INT) AS "index" FROM kept k JOIN best b ON b.frame_id = k.frame_id AND b.start = k.start JOIN fx_truth t ON t.frame_id = k.frame_id""",
    COUNTED,
)
def e3(spark, sf):
    plan = corner_plan(spark, sf)
    corners = fit.complete_corners(peaks(spark, sf))
    est = cut(fit.corner_estimators(plan.select("frame_id", "white_keys", "phase").join(corners, "frame_id")))
    return fit.count_gaps(peaks(spark, sf), est).select("frame_id", "white_keys", "phase", "ord", "index")


POOL = """
tr0 AS (SELECT frame_id, white_keys, phase, width, height, h0, h1, h2, h3, h4, h5, h6, h7, h8, h4*h8 - h5*h7 AS c00, h2*h7 - h1*h8 AS c10, h1*h5 - h2*h4 AS c20,
 h5*h6 - h3*h8 AS c01, h0*h8 - h2*h6 AS c11, h2*h3 - h0*h5 AS c21, h3*h7 - h4*h6 AS c02, h1*h6 - h0*h7 AS c12, h0*h4 - h1*h3 AS c22 FROM fx_truth),
tr AS (SELECT frame_id, white_keys, phase, width, height, h0, h1, h2, h3, h4, h5, h6, h7, h8, c00 / (h0*c00 + h1*c01 + h2*c02) AS c00, c01 / (h0*c00 + h1*c01 + h2*c02) AS c01, c02 / (h0*c00 + h1*c01 + h2*c02) AS c02, c10 / (h0*c00 + h1*c01 + h2*c02) AS c10, c11 / (h0*c00 + h1*c01 + h2*c02) AS c11, c12 / (h0*c00 + h1*c01 + h2*c02) AS c12, c20 / (h0*c00 + h1*c01 + h2*c02) AS c20, c21 / (h0*c00 + h1*c01 + h2*c02) AS c21, c22 / (h0*c00 + h1*c01 + h2*c02) AS c22 FROM tr0),
seen AS (SELECT p.frame_id, p.channel, p.ord, p.x, p.y, t.white_keys, t.phase, (c00*p.x + c10*p.y + c20) / (c02*p.x + c12*p.y + c22) AS tx, (c01*p.x + c11*p.y + c21) / (c02*p.x + c12*p.y + c22) AS ty
 FROM fx_fit_peaks p JOIN tr t ON p.frame_id = t.frame_id),
snapped_gaps AS (SELECT frame_id, channel, ord, floor(tx + 5e-1) AS src_x, CASE WHEN channel = 4 THEN 1e0 ELSE 0e0 END AS src_y, x AS dst_x, y AS dst_y FROM seen
 WHERE channel IN (4, 9) AND floor(tx + 5e-1) >= 1 AND floor(tx + 5e-1) <= white_keys - 1 AND abs(tx - floor(tx + 5e-1)) < 3e-1),
near AS (SELECT s.frame_id, s.channel, s.ord, t.x AS src_x, s.x, s.y, abs(t.x - s.tx) AS d, row_number() OVER (PARTITION BY s.frame_id, s.channel, s.ord ORDER BY abs(t.x - s.tx), t.ord) AS rn
 FROM seen s JOIN fx_template t ON s.white_keys = t.white_keys AND s.phase = t.phase AND s.channel = t.channel WHERE s.channel IN (5, 6)),
snapped_blacks AS (SELECT frame_id, channel, ord, src_x, 62e-2 AS src_y, x AS dst_x, y AS dst_y FROM near WHERE rn = 1 AND d < 3e-1),
pool AS (SELECT frame_id, channel, ord, src_x, src_y, dst_x, dst_y, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN channel <= 4 THEN channel WHEN channel = 9 THEN 45e-1 ELSE channel END, ord) - 1 AS pos FROM (
 SELECT frame_id, channel, ord, CASE WHEN channel IN (1, 2) THEN CAST(white_keys AS DOUBLE) ELSE 0e0 END AS src_x, CASE WHEN channel >= 2 THEN 1e0 ELSE 0e0 END AS src_y, x AS dst_x, y AS dst_y FROM seen WHERE channel <= 3
 UNION ALL SELECT * FROM snapped_gaps UNION ALL SELECT * FROM snapped_blacks) p)"""
POOL_VIEWS = ("fx_truth", "fx_fit_peaks", "fx_template")
SNAP = "SELECT frame_id, channel, CAST(ord AS BIGINT) AS ord, round(src_x, 6) AS src_x, round(src_y, 6) AS src_y FROM "


def prior_peaks(spark, sf):
    """The candidates' peaks placed through the planted fits alone."""
    plan = prior_plan(spark, sf)
    est = F.array(*[G.at("prior_inverse", i) for i in (0, 1, 2, 6, 7, 8)])
    return plan.select("frame_id", "cand", "white_keys", "phase", "shift", est.alias("est")).join(peaks(spark, sf), "frame_id")


def snapped(df):
    return df.select("frame_id", "channel", "ord", r6("src_x").alias("src_x"), r6("src_y").alias("src_y"))


@query("e4_snap_gaps", POOL_VIEWS, SNAP + "snapped_gaps", POOL)
def e4(spark, sf):
    return snapped(fit.snap_gaps(prior_peaks(spark, sf)))


@query("e5_snap_blacks", POOL_VIEWS, SNAP + "snapped_blacks", POOL)
def e5(spark, sf):
    return snapped(fit.snap_blacks(prior_peaks(spark, sf)))


@query("e6_build_pool", POOL_VIEWS, "SELECT frame_id, pos, channel, round(src_x, 6) AS src_x, round(src_y, 6) AS src_y FROM pool", POOL)
def e6(spark, sf):
    return fit.build_pool(prior_peaks(spark, sf)).select("frame_id", "pos", "channel", r6("src_x").alias("src_x"), r6("src_y").alias("src_y"))


# the generator in unsigned 64-bit arithmetic, then one draw per step with the sample so far as state
PICKS = POOL + """,
lens AS MATERIALIZED (SELECT DISTINCT n FROM (SELECT count(*) AS n FROM pool GROUP BY frame_id) c WHERE n >= 4),
a AS (SELECT i, (2654435769 + (i + 1) * 1831565813) % 4294967296 AS a FROM (SELECT CAST(range AS UBIGINT) AS i FROM range(6000)) r),
b AS (SELECT i, (xor(a, a >> 15) * (a | 1::UBIGINT)) % 4294967296 AS t FROM a),
c AS (SELECT i, xor((t + (xor(t, t >> 7) * (t | 61::UBIGINT)) % 4294967296) % 4294967296, t) AS t FROM b),
u AS MATERIALIZED (SELECT CAST(i AS BIGINT) AS i, CAST(xor(t, t >> 14) AS DOUBLE) / 4294967296e0 AS u FROM c),
step AS (SELECT n, CAST(0 AS BIGINT) AS i, 0 AS iter, CAST([] AS BIGINT[]) AS got FROM lens /*recursive*/
 UNION ALL SELECT s.n, s.i + 1, CASE WHEN len(s.got) = 4 THEN s.iter + 1 ELSE s.iter END,
  CASE WHEN len(s.got) = 4 THEN [CAST(floor(u.u * s.n) AS BIGINT)] WHEN list_contains(s.got, CAST(floor(u.u * s.n) AS BIGINT)) THEN s.got ELSE list_append(s.got, CAST(floor(u.u * s.n) AS BIGINT)) END
 FROM step s JOIN u ON u.i = s.i WHERE s.iter < 199 OR len(s.got) < 4)"""


@query(
    "e7_sample_picks",
    POOL_VIEWS,
    """SELECT pool_len, iter, CAST(k AS INT) AS k, got[k + 1] AS pos FROM (SELECT n AS pool_len, iter, got, unnest(range(4)) AS k FROM (SELECT DISTINCT n, iter, got FROM step WHERE len(got) = 4) s) t""",
    PICKS,
)
def e7(spark, sf):
    lengths = fit.build_pool(prior_peaks(spark, sf)).groupBy("frame_id", "cand").agg(F.count(F.lit(1)).alias("pool_len"))
    return picks.sample_picks(lengths)


def _basis_sql(kind: str, out: str, source: str) -> str:
    """Three weighted points of each four as columns, in SQL."""
    def det(p, q, r):
        return f"({p}x{kind} * ({q}y{kind} - {r}y{kind}) + {q}x{kind} * ({r}y{kind} - {p}y{kind}) + {r}x{kind} * ({p}y{kind} - {q}y{kind}))"

    weights = {"a": det("b", "c", "d"), "b": det("c", "a", "d"), "c": det("a", "b", "d")}
    cols = ", ".join(f"{w} * {p}x{kind} AS {kind}{p}0, {w} * {p}y{kind} AS {kind}{p}1, {w} AS {kind}{p}2" for p, w in weights.items())
    return f"{out} AS (SELECT *, {cols} FROM {source})"


def _vote_sql() -> str:
    def cross(p, q, i):
        j, k = (i + 1) % 3, (i + 2) % 3
        return f"(s{p}{j} * s{q}{k} - s{p}{k} * s{q}{j})"

    rows = [("a", cross, "b", "c"), ("b", cross, "c", "a"), ("c", cross, "a", "b")]
    h = ", ".join(" + ".join(f"t{p}{i} * {f(q, r, j)}" for p, f, q, r in rows) + f" AS g{3 * i + j}" for i in range(3) for j in range(3))
    sines = " OR ".join(
        f"(CASE WHEN (sqrt(({q}xs-{p}xs)**2 + ({q}ys-{p}ys)**2) * sqrt(({r}xs-{p}xs)**2 + ({r}ys-{p}ys)**2)) > 0 THEN "
        f"abs(({q}xs-{p}xs)*({r}ys-{p}ys) - ({q}ys-{p}ys)*({r}xs-{p}xs)) / (sqrt(({q}xs-{p}xs)**2 + ({q}ys-{p}ys)**2) * sqrt(({r}xs-{p}xs)**2 + ({r}ys-{p}ys)**2)) ELSE 0e0 END) < 1e-6"
        for p, q, r in ("bcd", "acd", "abd", "abc")
    )
    at = ", ".join(f"{p}.src_x AS {p}xs, {p}.src_y AS {p}ys, {p}.dst_x AS {p}xt, {p}.dst_y AS {p}yt" for p in "abcd")
    joins = " ".join(f"JOIN pool {p} ON {p}.frame_id = z.frame_id AND {p}.pos = k.got[{i + 1}]" for i, p in enumerate("abcd"))

    def put(dx, i):
        return f"(h{3 * i} * (src_x + {dx}) + h{3 * i + 1} * src_y + h{3 * i + 2}) / (h6 * (src_x + {dx}) + h7 * src_y + 1)"

    return PICKS + f""",
four AS MATERIALIZED (SELECT z.frame_id, k.iter, {at} FROM (SELECT frame_id, count(*) AS n FROM pool GROUP BY 1) z
 JOIN (SELECT DISTINCT n, iter, got FROM step WHERE len(got) = 4) k ON k.n = z.n {joins}),
sound AS (SELECT * FROM four WHERE NOT ({sines})),
{_basis_sql("s", "based", "sound")}, {_basis_sql("t", "both_based", "based")},
raw AS (SELECT frame_id, iter, {h} FROM both_based),
hyp AS MATERIALIZED (SELECT frame_id, iter, {", ".join(f"g{i} / g8 AS h{i}" for i in range(8))} FROM raw WHERE g8 <> 0),
tried AS (SELECT y.frame_id, y.iter, h2, h5, sqrt(({put("0e0", 0)} - dst_x)**2 + ({put("0e0", 1)} - dst_y)**2)
  < 25e-2 * sqrt(({put("5e-1", 0)} - {put("-5e-1", 0)})**2 + ({put("5e-1", 1)} - {put("-5e-1", 1)})**2) AS agrees FROM hyp y JOIN pool p ON p.frame_id = y.frame_id),
votes AS (SELECT frame_id, iter, h2, h5, count(CASE WHEN agrees THEN 1 END) AS votes FROM tried GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY votes DESC, iter) AS place FROM votes)"""


@query(
    "e8_vote", POOL_VIEWS, "SELECT frame_id, CAST(0 AS INT) AS cand, votes, round(h2, 4) AS h2, round(h5, 4) AS h5 FROM won WHERE place = 1", _vote_sql()
)
def e8(spark, sf):
    won = fit.vote(fit.build_pool(prior_peaks(spark, sf)))
    return won.select("frame_id", "cand", "votes", *[F.round(G.at("homography", i), 4).alias(f"h{i}") for i in (2, 5)])


@query("e9_refine")
def e9(spark, sf):
    pool = fit.build_pool(prior_peaks(spark, sf))
    fits = fit.refine_votes(pool, fit.vote(pool))
    return fits.select("frame_id", *[F.round(G.at("homography", i), 4).alias(f"h{i}") for i in range(9)])


# fits to judge: the planted ones, a little off, some so far off that they must be refused
MOVED = """,
moved AS (SELECT frame_id, white_keys, phase, width, height, h0 * (1e0 + (frame_id % 5) / 2e3) AS h0, h1, h2 + CASE WHEN frame_id % 7 = 0 THEN 6e-3 ELSE 0e0 END AS h2, h3, h4, h5 + CAST(frame_id % 3 - 1 AS DOUBLE) / 1e3 AS h5, h6, h7, h8 FROM tr),
j AS (SELECT p.*, m.width, m.height, (h0*src_x + h1*src_y + h2) / (h6*src_x + h7*src_y + h8) AS px, (h3*src_x + h4*src_y + h5) / (h6*src_x + h7*src_y + h8) AS py,
 sqrt(((h0*(src_x + 5e-1) + h1*src_y + h2) / (h6*(src_x + 5e-1) + h7*src_y + h8) - (h0*(src_x - 5e-1) + h1*src_y + h2) / (h6*(src_x - 5e-1) + h7*src_y + h8))**2
  + ((h3*(src_x + 5e-1) + h4*src_y + h5) / (h6*(src_x + 5e-1) + h7*src_y + h8) - (h3*(src_x - 5e-1) + h4*src_y + h5) / (h6*(src_x - 5e-1) + h7*src_y + h8))**2) * 25e-2 AS tol
 FROM pool p JOIN moved m ON p.frame_id = m.frame_id),
k AS (SELECT *, sqrt((px - dst_x)**2 + (py - dst_y)**2) < tol AS inl, sqrt(((px - dst_x) * width)**2 + ((py - dst_y) * height)**2) AS err FROM j),
agg AS (SELECT frame_id, count(*) AS n, count(CASE WHEN inl THEN 1 END) AS inliers, list_sort(list(err) FILTER (WHERE inl)) AS errs FROM k GROUP BY 1),
qc AS (SELECT m.frame_id, m.white_keys, m.width, m.height, h2 / h8 AS x0, h5 / h8 AS y0, (h0*white_keys + h2) / (h6*white_keys + h8) AS x1, (h3*white_keys + h5) / (h6*white_keys + h8) AS y1,
 (h0*white_keys + h1 + h2) / (h6*white_keys + h7 + h8) AS x2, (h3*white_keys + h4 + h5) / (h6*white_keys + h7 + h8) AS y2, (h1 + h2) / (h7 + h8) AS x3, (h4 + h5) / (h7 + h8) AS y3 FROM moved m),
qe AS (SELECT *, sqrt((x1-x0)**2 + (y1-y0)**2) AS e0, sqrt((x2-x1)**2 + (y2-y1)**2) AS e1, sqrt((x3-x2)**2 + (y3-y2)**2) AS e2, sqrt((x0-x3)**2 + (y0-y3)**2) AS e3,
 (sqrt(((x1-x0)*width)**2 + ((y1-y0)*height)**2) + sqrt(((x2-x3)*width)**2 + ((y2-y3)*height)**2)) / 2e0 / white_keys AS key_px FROM qc),
fitted AS (SELECT q.frame_id, a.inliers, a.n AS pool_len, CAST(a.inliers AS DOUBLE) / a.n AS share, a.errs[CAST(floor(a.inliers / 2) AS BIGINT) + 1] AS med, key_px FROM qe q JOIN agg a ON q.frame_id = a.frame_id
 WHERE CAST(a.inliers AS DOUBLE) / a.n >= 6e-1 AND least(e0, e1, e2, e3) >= 1e-2 AND ((e0 + e2) / 2e0) / greatest((e1 + e3) / 2e0, 1e-2) BETWEEN 18e-1 AND 3e1 AND greatest(e1, e3) / greatest(least(e1, e3), 1e-2) <= 32e-1
 AND a.errs[CAST(floor(a.inliers / 2) AS BIGINT) + 1] < 15e-2 * key_px)"""
JUDGED = POOL + MOVED

METRICS = JUDGED + """,
inv2 AS (SELECT m.*, h4*h8 - h5*h7 AS c00, h2*h7 - h1*h8 AS c10, h1*h5 - h2*h4 AS c20, h5*h6 - h3*h8 AS c01, h0*h8 - h2*h6 AS c11, h2*h3 - h0*h5 AS c21, h3*h7 - h4*h6 AS c02, h1*h6 - h0*h7 AS c12, h0*h4 - h1*h3 AS c22
 FROM moved m JOIN fitted f ON m.frame_id = f.frame_id),
on_t AS (SELECT p.*, i.white_keys AS wk, (c00*p.x + c10*p.y + c20) / (c02*p.x + c12*p.y + c22) AS tx, (c01*p.x + c11*p.y + c21) / (c02*p.x + c12*p.y + c22) AS ty FROM fx_fit_peaks p JOIN inv2 i ON p.frame_id = i.frame_id),
det AS (SELECT frame_id, count(*) AS detected FROM fx_fit_peaks WHERE channel <= 6 OR channel = 9 GROUP BY 1),
steps AS (SELECT frame_id, tx - lag(tx) OVER (PARTITION BY frame_id ORDER BY tx, ord) AS s FROM on_t WHERE channel = 4 AND abs(ty - 1e0) < 3e-1),
spacing AS (SELECT frame_id, list_sort(list(s))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS sp FROM steps WHERE s > 4e-1 AND s < 15e-1 GROUP BY 1 HAVING count(*) >= 6),
beyond AS (SELECT frame_id, count(CASE WHEN abs(ty - CASE WHEN channel = 4 THEN 1e0 ELSE 62e-2 END) < 15e-2 AND (tx < -5e-1 OR tx > wk + 5e-1) THEN 1 END) AS b FROM on_t WHERE channel IN (4, 5, 6) GROUP BY 1),
ce AS (SELECT p.frame_id, p.channel, p.x, p.y, i.*, CASE WHEN p.channel IN (1, 2) THEN CAST(i.white_keys AS DOUBLE) ELSE 0e0 END AS ex, CASE WHEN p.channel >= 2 THEN 1e0 ELSE 0e0 END AS ey FROM fx_fit_peaks p JOIN inv2 i ON p.frame_id = i.frame_id WHERE p.channel <= 3),
cs AS (SELECT frame_id, channel, sqrt(((h0*ex + h1*ey + h2) / (h6*ex + h7*ey + h8) - x)**2 + ((h3*ex + h4*ey + h5) / (h6*ex + h7*ey + h8) - y)**2) AS d,
 sqrt(((h0*(ex + 5e-1) + h1*ey + h2) / (h6*(ex + 5e-1) + h7*ey + h8) - (h0*(ex - 5e-1) + h1*ey + h2) / (h6*(ex - 5e-1) + h7*ey + h8))**2
  + ((h3*(ex + 5e-1) + h4*ey + h5) / (h6*(ex + 5e-1) + h7*ey + h8) - (h3*(ex - 5e-1) + h4*ey + h5) / (h6*(ex - 5e-1) + h7*ey + h8))**2) * 125e-2 AS tol FROM ce),
ends AS (SELECT frame_id, max(CASE WHEN channel IN (0, 3) AND d < tol THEN 1 ELSE 0 END) AS low, max(CASE WHEN channel IN (1, 2) AND d < tol THEN 1 ELSE 0 END) AS high FROM cs GROUP BY 1),
metrics AS (SELECT f.frame_id, CAST(f.inliers AS DOUBLE) / greatest(d.detected, 1) AS explained, s.sp, coalesce(b.b, 0) AS beyond, coalesce(e.low * e.high, 0) AS both_ends FROM fitted f
 LEFT JOIN det d ON d.frame_id = f.frame_id LEFT JOIN spacing s ON s.frame_id = f.frame_id LEFT JOIN beyond b ON b.frame_id = f.frame_id LEFT JOIN ends e ON e.frame_id = f.frame_id)"""


def moved_fits(spark, sf):
    f = F.col("frame_id")
    h = [F.col(c) for c in H9]
    h[0] = h[0] * (F.lit(1.0) + (f % 5) / F.lit(2000.0))
    h[2] = h[2] + F.when(f % 7 == 0, 6e-3).otherwise(0.0)
    h[5] = h[5] + (f % 3 - 1).cast("double") / 1000.0
    return truth(spark, sf).select("frame_id", F.lit(0).alias("cand"), "white_keys", "phase", "width", "height", F.lit(False).alias("locked"), F.array(*h).alias("homography"))


def accepted(spark, sf):
    return cut(fit.accept_fits(fit.pool_rows(prior_peaks(spark, sf)), moved_fits(spark, sf)))


@query("e10_accept_fits", POOL_VIEWS, "SELECT frame_id, inliers, pool_len, round(share, 6) AS inlier_share, round(med, 6) AS reprojection_error, round(key_px, 6) AS key_px FROM fitted", JUDGED)
def e10(spark, sf):
    return accepted(spark, sf).select("frame_id", "inliers", "pool_len", *[r6(c).alias(c) for c in ("inlier_share", "reprojection_error", "key_px")])


@query("e11_explained", POOL_VIEWS, "SELECT frame_id, round(explained, 6) AS explained FROM metrics", METRICS)
def e11(spark, sf):
    return fit.with_explained(accepted(spark, sf), peaks(spark, sf)).select("frame_id", r6("explained").alias("explained"))


@query("e12_gap_spacing", POOL_VIEWS, "SELECT frame_id, round(sp, 6) AS gap_spacing FROM spacing", METRICS)
def e12(spark, sf):
    return fit.gap_spacing(peaks(spark, sf), accepted(spark, sf)).select("frame_id", r6("gap_spacing").alias("gap_spacing"))


@query("e13_beyond_ends", POOL_VIEWS, "SELECT frame_id, b AS beyond_ends FROM beyond", METRICS)
def e13(spark, sf):
    return fit.beyond_ends(peaks(spark, sf), accepted(spark, sf)).select("frame_id", "beyond_ends")


@query("e14_ends_seen", POOL_VIEWS, "SELECT frame_id, low, high FROM ends", METRICS)
def e14(spark, sf):
    e = fit.ends_seen(peaks(spark, sf), accepted(spark, sf))
    return e.select("frame_id", F.col("low_seen").cast("int").alias("low"), F.col("high_seen").cast("int").alias("high"))


@query("e15_whole_board", POOL_VIEWS, "SELECT frame_id, round(explained, 6) AS explained, beyond AS beyond_ends, round(sp, 6) AS gap_spacing FROM metrics WHERE both_ends = 1 AND beyond <= 2 AND abs(sp - 1e0) < 8e-2", METRICS)
def e15(spark, sf):
    whole = fit.whole_board(fit.fit_metrics(accepted(spark, sf), peaks(spark, sf)))
    return whole.select("frame_id", r6("explained").alias("explained"), "beyond_ends", r6("gap_spacing").alias("gap_spacing"))


@query(
    "e16_best_fit",
    ("fx_peaks",),
    """SELECT frame_id, cand, explained FROM (SELECT frame_id, channel * 100 + ord AS cand, score AS explained, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, channel * 100 + ord) AS rn FROM fx_peaks) r WHERE rn = 1""",
)
def e16(spark, sf):
    fits = view(spark, sf, "fx_peaks").select("frame_id", (F.col("channel") * 100 + F.col("ord")).alias("cand"), F.col("score").alias("explained"))
    return fit.best_fit(fits)


@query("e_fit_frames")
def e_fit(spark, sf):
    """The whole chain on every frame: candidates from corners, counting, pool, vote, refit, gates."""
    fits = fit.fit_frames(peaks(spark, sf), corner_plan(spark, sf))
    return fits.select("frame_id", "white_keys", "phase", "inliers", F.round("explained", 3).alias("explained"))
