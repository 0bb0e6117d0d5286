"""Fitting boards to the peaks of many frames at once.

A candidate is a board with a way to place peaks on its template's x axis; everything after that is
a join or an aggregate over (frame, candidate). Only linear systems are solved outside SQL, in batches.
An estimator is six numbers: x = (e0 px + e1 py + e2) / (e3 px + e4 py + e5).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions import picks as P
from tonewheel.functions.geometry import at, col, div, js_round, point
from tonewheel.functions.lineage import beside, cut, spread
from tonewheel.functions.quantiles import quantiles_of_few
from tonewheel.functions.walk import bundles
from tonewheel.operators import dims

# Fixed values of the fit.
SHIFTS = (0, -1, 1, -2, 2)
SNAP_KEYS = 0.3
COMPLETE_LEAST, COMPLETE_NEAREST = 6, 4
EDGE_SLACK, COUNT_LEAST, FIRST_STEPS, SHORTEST_STEP = 0.03, 6, 5, 0.6
VOTE_KEYS, INLIER_SHARE, ERROR_KEYS, LEAST_SINE = 0.25, 0.6, 0.15, 1e-6
SPACING_DEPTH, SPACING_LEAST, SPACING_MOST, SPACING_STEPS, SPACING_SLACK = 0.3, 0.4, 1.5, 6, 0.08
BEYOND_SLACK, BEYOND_ROW, BEYOND_ALLOWED = 0.5, 0.15, 2
END_SLACK_KEYS = 1.25
#: Rows of one pool that are counted in one place.
PART = 1 << 16

XY = ["src_x", "src_y", "dst_x", "dst_y"]
CAND = ["frame_id", "cand"]
BOARD = ["frame_id", "white_keys", "phase"]


def candidate_plan(frames: DataFrame, locks: DataFrame, priors: DataFrame) -> DataFrame:
    """The candidates to try per frame, in the order they are tried.

    A locked board is tried alone, through its prior fit when that is of the same board; with no
    lock every standard board is tried at five numberings.
    """
    lock = locks.select("frame_id", F.struct("white_keys", "phase").alias("_lock"))
    prior = priors.select("frame_id", F.struct("white_keys", "phase").alias("_of"), G.invert("homography").alias("_inverse"))
    met = frames.join(lock, "frame_id", "left").join(prior, "frame_id", "left")
    through = F.when((F.col("_of") == F.col("_lock")) & F.col("_inverse").isNotNull(), F.col("_inverse"))

    def option(board, shift, inverse):
        return F.struct(
            board["white_keys"].alias("white_keys"), board["phase"].alias("phase"), F.lit(shift).alias("shift"), inverse.alias("prior_inverse")
        )

    none = F.lit(None).cast("array<double>")
    boards = [F.struct(F.lit(w).alias("white_keys"), F.lit(p).alias("phase")) for w, p in dims.STANDARD_BOARDS]
    every = F.array(*[option(b, s, none) for b in boards for s in SHIFTS])
    one = F.array(option(F.col("_lock"), 0, through))
    plan = met.withColumn("_options", F.when(F.col("_lock").isNull(), every).otherwise(one))
    return plan.select(*frames.columns, F.col("_lock").isNotNull().alias("locked"), F.posexplode("_options").alias("cand", "o")).select(
        *frames.columns, "locked", "cand", "o.*"
    )


def corner_row(peaks: DataFrame) -> DataFrame:
    """One row per frame: c0 to c3, the detected corners."""
    def corner(c):
        return F.min(F.when(F.col("channel") == c, F.struct("ord", point("x", "y").alias("p"))))["p"].alias(f"c{c}")

    return peaks.where("channel <= 3").groupBy("frame_id").agg(*[corner(c) for c in range(4)])


def complete_corners(peaks: DataFrame) -> DataFrame:
    """The corners with a hidden back one placed behind its front one.

    The way back is read off the black keys nearest the four gaps nearest that end.
    """
    counts = peaks.groupBy("frame_id").agg(
        F.count(F.when(F.col("channel") == 4, 1)).alias("_gaps"), F.count(F.when(F.col("channel").isin(5, 6), 1)).alias("_blacks")
    )
    corners = corner_row(peaks).join(counts, "frame_id")
    wanting = corners.where(
        F.col("c2").isNotNull() & F.col("c3").isNotNull() & (F.col("c0").isNull() | F.col("c1").isNull())
        & (F.col("_gaps") >= COMPLETE_LEAST) & (F.col("_blacks") >= COMPLETE_LEAST)
    )
    ends = wanting.select(
        "frame_id",
        F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("c3").alias("front")), F.struct(F.lit(1).alias("end"), F.col("c2").alias("front")))).alias("e"),
    ).select("frame_id", "e.end", "e.front")
    gaps = peaks.where("channel = 4").select("frame_id", F.col("ord").alias("_ord"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    away = G.length(F.col("gx") - F.col("front.x"), F.col("gy") - F.col("front.y"))
    w = Window.partitionBy("frame_id", "end").orderBy(away, "_ord")
    nearest = ends.join(gaps, "frame_id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= COMPLETE_NEAREST)
    blacks = peaks.where(F.col("channel").isin(5, 6)).select("frame_id", "channel", F.col("ord").alias("_bord"), F.col("x").alias("bx"), F.col("y").alias("by"))
    apart = G.length(F.col("bx") - F.col("gx"), F.col("by") - F.col("gy"))
    offsets = nearest.join(blacks, "frame_id").groupBy("frame_id", "end", "_n").agg(
        F.min_by(F.struct((F.col("bx") - F.col("gx")).alias("x"), (F.col("by") - F.col("gy")).alias("y")), F.struct(apart, "channel", "_bord")).alias("o")
    )
    share = 1.0 - dims.BLACK_DEPTH
    ups = offsets.groupBy("frame_id").agg(
        *[F.avg(F.when(F.col("end") == e, F.col(f"o.{a}") / F.lit(share))).alias(f"u{e}{a}") for e in (0, 1) for a in "xy"]
    )
    met = corners.join(ups, "frame_id", "left")

    def behind(back, front, e):
        moved = F.when(F.col(f"u{e}x").isNotNull(), point(F.col(f"{front}.x") + F.col(f"u{e}x"), F.col(f"{front}.y") + F.col(f"u{e}y")))
        return F.coalesce(back, moved).alias(back)

    return met.select("frame_id", behind("c0", "c3", 0), behind("c1", "c2", 1), "c2", "c3")


def _det3(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _solve3(m, rhs) -> list[Column]:
    """Cramer's rule on a 3x3 system of columns."""
    det = _det3(m)
    out = []
    for k in range(3):
        replaced = [[rhs[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]
        out.append(div(_det3(replaced), det))
    return out


def corner_estimators(corners: DataFrame) -> DataFrame:
    """`est` per row of (frame_id, white_keys, phase, c0..c3): the inverse of the four corners'
    homography, or a least-squares affine from three, or NULL."""
    n = F.col("white_keys").cast("double")
    cs = [F.col(f"c{i}") for i in range(4)]
    tx = [F.lit(0.0), n, n, F.lit(0.0)]
    present = [c.isNotNull().cast("double") for c in cs]
    xs = [F.coalesce(c["x"], F.lit(0.0)) for c in cs]
    ys = [F.coalesce(c["y"], F.lit(0.0)) for c in cs]
    count = G.total(present)

    def s(*factors):
        terms = []
        for i in range(4):
            t = present[i]
            for f in factors:
                t = t * f[i]
            terms.append(t)
        return G.total(terms)

    named = {
        "xx": s(xs, xs), "xy": s(xs, ys), "sx": s(xs), "yy": s(ys, ys), "sy": s(ys), "n": count,
        "bx": s(xs, tx), "by": s(ys, tx), "b": s(tx),
    }
    sums = corners.withColumn("_s", F.struct(*[v.alias(k) for k, v in named.items()]))

    def affine(v):
        sol = _solve3(
            [[v["xx"], v["xy"], v["sx"]], [v["xy"], v["yy"], v["sy"]], [v["sx"], v["sy"], v["n"]]], [v["bx"], v["by"], v["b"]]
        )
        ok = (v["n"] >= 3) & sol[0].isNotNull()
        return F.when(ok, F.array(*sol, F.lit(0.0), F.lit(0.0), F.lit(1.0)))

    exact = F.when(count == 4, G.let(G.square_to(F.array(*cs), "white_keys"), estimator_of))
    return sums.withColumn("est", F.coalesce(exact, G.let(F.col("_s"), affine))).drop("_s")


def estimator_of(h) -> Column:
    """The estimator a homography's inverse gives."""
    return G.let(G.invert(h), lambda m: F.when(m.isNotNull(), F.array(*[at(m, i) for i in (0, 1, 2, 6, 7, 8)])))


def estimate(est, x, y) -> Column:
    x, y = col(x), col(y)
    return div(at(est, 0) * x + at(est, 1) * y + at(est, 2), at(est, 3) * x + at(est, 4) * y + at(est, 5))


def edge_gaps(peaks: DataFrame) -> DataFrame:
    """Gaps lying on the front edge, with how far along it."""
    corners = corner_row(peaks).where(F.col("c2").isNotNull() & F.col("c3").isNotNull())
    gaps = peaks.where("channel = 4").join(corners, "frame_id")
    dx, dy = F.col("c2.x") - F.col("c3.x"), F.col("c2.y") - F.col("c3.y")
    gx, gy = F.col("x") - F.col("c3.x"), F.col("y") - F.col("c3.y")
    length = G.length(dx, dy)
    t, off = div(gx * dx + gy * dy, length * length), div(F.abs(gx * dy - gy * dx), length)
    return gaps.select("frame_id", "ord", "x", "y", t.alias("t"), (off < length * EDGE_SLACK).alias("_near")).where(
        "_near and t > 0 and t < 1"
    ).drop("_near")


def step_along(edge: DataFrame) -> DataFrame:
    """A walk along the edge that counts keys by a spacing drifting with the view; its first half, which drifts least.

    A frame's gaps, bounded by its score grid, are one sorted array that the walk folds over.
    """
    def follow(state, t):
        step = t - state["last"]
        keys = F.greatest(js_round(div(step, state["spacing"])), F.lit(1)).cast("double")
        index = state["index"] + keys
        taken = F.struct(
            ((state["spacing"] + step / keys) / 2.0).alias("spacing"), t.alias("last"), index.alias("index"),
            F.concat(state["steps"], F.array(F.struct(t.alias("t"), index.alias("index")))).alias("steps"),
        )
        return F.when(step < state["spacing"] * SHORTEST_STEP, state).otherwise(taken)

    gaps = edge.groupBy("frame_id").agg(F.sort_array(F.collect_list("t")).alias("_t")).where(F.size("_t") > FIRST_STEPS)
    between = F.transform(F.sequence(F.lit(1), F.lit(FIRST_STEPS)), lambda i: F.get("_t", i) - F.get("_t", i - 1))
    started = gaps.withColumn("_spacing", at(F.array_sort(between), FIRST_STEPS // 2)).where("_spacing > 0")
    index = F.greatest(js_round(at("_t", 0) / F.col("_spacing")), F.lit(1)).cast("double")
    first = F.struct(
        F.col("_spacing").alias("spacing"), at("_t", 0).alias("last"), index.alias("index"), F.array(F.struct(at("_t", 0).alias("t"), index.alias("index"))).alias("steps")
    )
    walked = started.select("frame_id", F.aggregate(F.slice("_t", 2, F.size("_t")), first, follow, lambda state: state["steps"]).alias("_s"))
    half = F.ceil(F.size("_s") / 2).cast("int")
    return walked.select("frame_id", F.explode(F.slice("_s", 1, half)).alias("_s")).select("frame_id", "_s.t", "_s.index")


def edge_maps(points: DataFrame, keys: list[str]) -> DataFrame:
    """The projective map from key index to place on the edge, anchored at the corners.

    `points` has the keys (with white_keys among them), t and index. Fewer than six points map nothing.
    """
    i, t = F.col("index"), F.col("t")
    terms = {"ii": i * i, "i": i, "iit": i * i * t, "it": i * t, "iitt": i * i * t * t, "t": t, "itt": i * t * t}
    sums = points.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).alias(f"s_{k}") for k, v in terms.items()])
    sums = sums.where(F.col("n") >= COUNT_LEAST)
    n, k = F.col("n"), F.col("white_keys").cast("double")
    s = {name: F.col(f"s_{name}") for name in terms}
    m = F.struct(
        (s["ii"] + n * k * k).alias("a"), (s["i"] + n * k).alias("b"), (-s["iit"] - n * k * k).alias("c"), (n * 3.0).alias("d"),
        (-s["it"] - n * k).alias("e"), (s["iitt"] + n * k * k).alias("f"), (s["it"] + n * k).alias("u"), (s["t"] + n).alias("v"), (-s["itt"] - n * k).alias("w"),
    )

    def solved(v):
        p = _solve3([[v["a"], v["b"], v["c"]], [v["b"], v["d"], v["e"]], [v["c"], v["e"], v["f"]]], [v["u"], v["v"], v["w"]])
        return F.when(p[0].isNotNull(), F.struct(p[0].alias("p"), p[1].alias("q"), p[2].alias("r")))

    return sums.select(*keys, G.let(m, solved).alias("map")).where("map is not null")


def _number(edge: DataFrame, maps: DataFrame) -> DataFrame:
    exact = div(F.col("t") - F.col("map.q"), F.col("map.p") - F.col("map.r") * F.col("t"))
    met = maps.join(edge, "frame_id").withColumn("_exact", exact).withColumn("index", js_round("_exact").cast("double"))
    return met.where(
        (F.col("index") >= 1) & (F.col("index") < F.col("white_keys")) & (F.abs(F.col("_exact") - F.col("index")) < SNAP_KEYS)
    ).withColumn("_error", F.abs(F.col("_exact") - F.col("index"))).drop("map", "_exact")


def count_gaps(peaks: DataFrame, estimators: DataFrame) -> DataFrame:
    """Each gap on the front edge with the key boundary it is: frame_id, white_keys, phase, ord, x, y, index.

    Two starts, the walk's first half and the corners' guess, are numbered along the edge and
    refitted; the start that numbers more gaps wins, then the one closer to whole keys.
    """
    edge = edge_gaps(peaks)
    enough = edge.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= COUNT_LEAST).select("frame_id")
    edge = cut(edge.join(enough, "frame_id", "left_semi"))
    boards = estimators.select(*BOARD, "est")
    walked = boards.join(step_along(edge), "frame_id").select(*BOARD, F.lit(0).alias("start"), "t", "index")
    guess = boards.where("est is not null").join(edge, "frame_id").withColumn("_g", estimate("est", "x", "y")).withColumn(
        "index", js_round("_g").cast("double")
    ).where(F.abs(F.col("_g") - F.col("index")) < SNAP_KEYS).select(*BOARD, F.lit(1).alias("start"), "t", "index")
    keys = [*BOARD, "start"]
    first = cut(_number(edge, edge_maps(walked.unionByName(guess), keys)))
    again = edge_maps(first, keys)
    # a start whose first numbering leaves too few gaps to refit keeps that numbering
    kept = cut(first.join(again.select(*keys), keys, "left_anti").unionByName(_number(edge, again)).drop("t"))
    scores = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_error").alias("e"))
    best = scores.groupBy(*BOARD).agg(F.min_by("start", F.struct(-F.col("n"), F.col("e"), F.col("start"))).alias("start"))
    return kept.join(best, keys, "left_semi").select(*BOARD, "ord", "x", "y", F.col("index").cast("int").alias("index"))


_SUMS = [(f, m) for f in ("1", "u", "v", "w") for m in ("1", "x", "y", "xx", "xy", "yy") if (f, m) != ("w", "1")]


def refine_homographies(pairs: DataFrame, keys: list[str], fallback: str | None = None, least: int = 0) -> DataFrame:
    """The least-squares homography per group of (src_x, src_y) to (dst_x, dst_y) pairs.

    The normal equations are 23 sums, combined before the shuffle; only they reach the solver.
    Where the system has no finite solution `homography` is the pairs' own `fallback`, or NULL. Groups of fewer than `least` pairs give no row.
    """
    x, y, u, v = (F.col(c) for c in ("src_x", "src_y", "dst_x", "dst_y"))
    factor = {"1": F.lit(1.0), "u": u, "v": v, "w": u * u + v * v}
    mono = {"1": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    # the fallback goes as plain numbers, which aggregate by hash; groups stay where their rows are
    named = [F.sum(factor[f] * mono[m]).alias(f"_s{i}") for i, (f, m) in enumerate(_SUMS)]
    named += [] if fallback is None else [F.max(at(fallback, i)).alias(f"_o{i}") for i in range(9)]
    grouped = pairs.groupBy(*keys).agg(*named, F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least) if least else pairs.groupBy(*keys).agg(*named)
    sums = grouped.select(*keys, F.array(*[f"_s{i}" for i in range(len(_SUMS))]).alias("_sums"), *[f"_o{i}" for i in range(0 if fallback is None else 9)])

    @F.pandas_udf("array<double>")
    def solved(given: pd.Series) -> pd.Series:
        from tonewheel.operators.solve import normal_homographies

        h = normal_homographies(np.array(given.tolist(), dtype=float).reshape(-1, len(_SUMS)))
        return pd.Series([r if np.isfinite(r).all() else None for r in h], dtype=object)

    other = None if fallback is None else F.array(*[f"_o{i}" for i in range(9)])
    found = sums.select(*keys, solved("_sums").alias("homography"), *([] if other is None else [other.alias("_other")]))
    return found if other is None else found.select(*keys, F.coalesce("homography", F.when(at("_other", 0).isNotNull(), F.col("_other"))).alias("homography"))


def estimators(peaks: DataFrame, boards: DataFrame) -> DataFrame:
    """Per (frame_id, white_keys, phase) the estimator to place peaks with before any fit.

    Counted gaps and corners give a least-squares homography; where gaps cannot be counted the
    corners alone speak.
    """
    corners = complete_corners(peaks)
    coarse = cut(corner_estimators(boards.select(*BOARD).distinct().join(corners, "frame_id")))
    counted = count_gaps(peaks, coarse)
    pairs = counted.select(*BOARD, F.col("index").cast("double").alias("src_x"), F.lit(1.0).alias("src_y"), F.col("x").alias("dst_x"), F.col("y").alias("dst_y"))
    n = F.col("white_keys").cast("double")
    placed = F.array(
        *[F.struct(F.col(f"c{i}").alias("p"), (n if i in (1, 2) else F.lit(0.0)).alias("tx"), F.lit(float(i >= 2)).alias("ty")) for i in range(4)]
    )
    ends = coarse.join(counted.select(*BOARD).distinct(), BOARD, "left_semi").select(*BOARD, F.explode(placed).alias("e")).where("e.p is not null")
    ends = ends.select(*BOARD, F.col("e.tx").alias("src_x"), F.col("e.ty").alias("src_y"), F.col("e.p.x").alias("dst_x"), F.col("e.p.y").alias("dst_y"))
    fitted = refine_homographies(pairs.unionByName(ends), BOARD).select(*BOARD, estimator_of("homography").alias("_counted"))
    return coarse.join(fitted, BOARD, "left").select(*BOARD, F.coalesce("_counted", "est").alias("est")).where("est is not null")


def snap_gaps(peaks: DataFrame) -> DataFrame:
    """Front and back gaps on the key boundary they fall nearest; `peaks` carry est and shift."""
    x = estimate("est", "x", "y") + F.col("shift")
    snapped = peaks.where(F.col("channel").isin(4, 9)).withColumn("_x", G.once(x)).withColumn("_i", js_round("_x").cast("double"))
    kept = snapped.where(
        (F.col("_i") >= 1) & (F.col("_i") <= F.col("white_keys") - 1) & (F.abs(F.col("_x") - F.col("_i")) < SNAP_KEYS)
    )
    return kept.select(
        *CAND, "channel", "ord", F.col("_i").alias("src_x"), F.when(F.col("channel") == 4, 1.0).otherwise(0.0).alias("src_y"),
        F.col("x").alias("dst_x"), F.col("y").alias("dst_y"),
    )


def snap_blacks(peaks: DataFrame, depth=None) -> DataFrame:
    """E5: black corners on the corner of their own board nearest along x, within the snap.

    Corners of a kind are a key apart, so the nearest is the only one that near, ties aside.
    """
    x = estimate("est", "x", "y") + F.col("shift")
    met = dims.template_near(peaks.where(F.col("channel").isin(5, 6)), x, F.col("channel"), SNAP_KEYS)
    deep = F.lit(dims.BLACK_DEPTH) if depth is None else col(depth)
    return met.select(
        *CAND, "channel", "ord", F.col("near_x").alias("src_x"), deep.alias("src_y"), F.col("x").alias("dst_x"), F.col("y").alias("dst_y")
    )


def snap_corners(peaks: DataFrame) -> DataFrame:
    n = F.col("white_keys").cast("double")
    c = F.col("channel")
    return peaks.where("channel <= 3").select(
        *CAND, "channel", "ord", F.when(c.isin(1, 2), n).otherwise(0.0).alias("src_x"), F.when(c >= 2, 1.0).otherwise(0.0).alias("src_y"),
        F.col("x").alias("dst_x"), F.col("y").alias("dst_y"),
    )


def pool_rows(peaks: DataFrame) -> DataFrame:
    """`snap_corners`, `snap_gaps` and `snap_blacks` in one pass over the peaks, which stay where they are."""
    c, x, n = F.col("channel"), F.col("_x"), F.col("white_keys")
    high, i = c == 6, js_round("_x")
    seen = peaks.where((c <= 6) | (c == 9)).withColumn("_x", G.once(estimate("est", "x", "y") + F.col("shift"))).withColumn("_start", G.once(dims.black_start("phase")))
    seen = seen.withColumn("_k", G.once(F.when(c.isin(5, 6), dims.black_near("_start", "white_keys", x, high))))
    begins = dims.black_at("_start", "white_keys", "_k")
    place = F.when(c <= 3, F.when(c.isin(1, 2), n.cast("double")).otherwise(0.0)).when(c.isin(4, 9), i.cast("double")).otherwise(F.when(high, begins + dims.BLACK_WIDTH).otherwise(begins))
    snapped = seen.withColumn("_to", G.once(place))
    to = F.col("_to")
    on = (c <= 3) | ((F.abs(x - to) < SNAP_KEYS) & (~c.isin(4, 9) | ((to >= 1) & (to <= n - 1))))
    row = F.when(c <= 3, F.when(c >= 2, 1.0).otherwise(0.0)).when(c == 4, 1.0).when(c == 9, 0.0).otherwise(dims.BLACK_DEPTH)
    return snapped.where(on).select(*CAND, "channel", "ord", to.alias("src_x"), row.alias("src_y"), F.col("x").alias("dst_x"), F.col("y").alias("dst_y"))


def build_pool(peaks: DataFrame) -> DataFrame:
    """Each candidate's correspondences at a dense position from 0: corners, gaps, back gaps, then
    the blacks' low and high corners.

    `peaks` are a candidate's: frame_id, cand, white_keys, phase, shift, est, channel, ord, x, y.
    """
    section = F.when(F.col("channel") <= 4, F.col("channel")).when(F.col("channel") == 9, 5).otherwise(F.col("channel") + 1)
    order = Window.partitionBy(*CAND).orderBy(section, "ord")
    # a pool's rows come from one frame's score grid; the window keeps the frames where the join put them and streams its sorted rows
    placed = pool_rows(peaks).withColumn("pos", F.row_number().over(order).cast("bigint") - 1)
    return placed.select(*CAND, "pos", "channel", "src_x", "src_y", "dst_x", "dst_y")


def inlier(h="homography") -> Column:
    """Whether a pool row lies within a quarter of a local key width of where `h` puts it."""
    tolerance = G.local_key_width(h, "src_x", "src_y") * VOTE_KEYS
    px, py = G.project(h, "src_x", "src_y")
    return F.coalesce(G.length(px - F.col("dst_x"), py - F.col("dst_y")) < tolerance, F.lit(False))


def vote(pool: DataFrame) -> DataFrame:
    """Per candidate the sample homography most of its pool agrees with, the earliest on ties.

    A pool's rows stay where its frame is and are counted there; which rows are sampled depends on the pool's length alone. Pools of more than
    PART rows are counted in parts.
    """
    def elect(key, info, rows):
        from tonewheel.operators.solve import elected

        if rows is None:
            return [(*key, None, None)]
        if len(rows) < P.SAMPLE:
            return []
        best = elected(rows, *P.sample_slots(len(rows)), P.ITERATIONS)
        return [] if best is None else [(*key, *best)]

    rows = pool.select(*CAND, "pos", *XY, F.lit(None).cast("array<double>").alias("info"))
    found = cut(bundles(rows, "frame_id", CAND, ["pos"], XY, PART, elect, "frame_id bigint, cand int, votes bigint, homography array<double>"))
    large = found.where("votes is null").select(*CAND)
    if large.isEmpty():
        return found
    return found.where("votes is not null").unionByName(_vote_in_parts(pool.join(large, CAND, "left_semi")))


def _vote_in_parts(pool: DataFrame) -> DataFrame:
    """`vote` for pools that never meet in one task.

    A pool's rows stream past its samples: the rows that any sample takes, at most four a sample, come first and give the homographies,
    then every row adds to an array of counts, one for each. Rows beyond PART of one pool go to further parts, each of which sees all samples, and the counts
    of the parts are added up. The samples are a small table of their own.
    """
    sizes = pool.groupBy(*CAND).agg(F.count(F.lit(1)).alias("pool_len")).where(F.col("pool_len") >= P.SAMPLE)
    slot = (F.col("iter") * P.SAMPLE + F.col("k")).cast("int")
    slots = P.sample_picks(sizes).groupBy("pool_len", "pos").agg(F.collect_list(slot).alias("slots"))
    marked = pool.join(sizes, CAND).join(slots, ["pool_len", "pos"], "left").withColumn("_own", F.floor(F.col("pos") / PART))
    every = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("pool_len") - 1) / PART))
    parts = F.when(F.col("slots").isNotNull(), every).otherwise(F.array("_own"))
    dealt = marked.select(*CAND, "pool_len", "slots", "pos", *XY, "_own", F.explode(parts).alias("_part"))
    key = [*CAND, "_part"]
    dealt = spread(dealt, *key).sortWithinPartitions(*key, F.col("slots").isNull(), "pos")

    def count(batches):
        import pandas as pd

        from tonewheel.operators.solve import Ballot

        def told(key, ballot):
            whole = ballot.pool_len <= PART
            return [(key[0], key[1], i, v, h.tolist()) for i, v, h in ballot.result(best_only=whole)]

        now, ballot, out = None, None, []
        for pdf in batches:
            ids = pdf[key].to_numpy()
            edges = [0, *((ids[1:] != ids[:-1]).any(axis=1).nonzero()[0] + 1), len(ids)] if len(ids) else [0]
            points, own, sampled = pdf[XY].to_numpy(), (pdf["_own"] == pdf["_part"]).to_numpy(), pdf["slots"].to_numpy()
            lengths = pdf["pool_len"].to_numpy()
            for a, b in zip(edges, edges[1:]):
                mine = tuple(ids[a].tolist())
                if mine != now:
                    if ballot is not None:
                        out += told(now, ballot)
                    now, ballot = mine, Ballot(int(lengths[a]), P.ITERATIONS)
                ballot.add(points[a:b], sampled[a:b], own[a:b])
            if out:
                yield pd.DataFrame(out, columns=["frame_id", "cand", "iter", "votes", "h"])
                out = []
        if ballot is not None:
            yield pd.DataFrame(told(now, ballot), columns=["frame_id", "cand", "iter", "votes", "h"])

    counts = dealt.mapInPandas(count, "frame_id bigint, cand int, iter int, votes bigint, h array<double>")
    totals = counts.groupBy(*CAND, "iter").agg(F.sum("votes").alias("votes"), F.first("h").alias("homography"))
    return totals.groupBy(*CAND).agg(
        F.min_by(F.struct("votes", "homography"), F.struct(-F.col("votes"), F.col("iter"))).alias("b")
    ).select(*CAND, "b.votes", "b.homography")


def refine_votes(pool: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each seed refitted over its inliers; a seed with fewer than four falls out, one whose
    refit has no solution stands."""
    strong = seeds.where(F.col("votes") >= P.SAMPLE).select(*CAND, "homography")
    return refine_homographies(beside(pool, strong, "frame_id", "cand").withColumn("_in", G.once(inlier())).where("_in"), CAND, "homography")


def board_quad(h, white_keys) -> Column:
    n = col(white_keys).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[G.project_point(h, x, y) for x, y in ((zero, zero), (n, zero), (n, one), (zero, one))])


def accept_fits(pool: DataFrame, fits: DataFrame) -> DataFrame:
    """Fits that keep enough of their pool, look like a keybed and land close enough.

    `fits` has frame_id, cand, white_keys, phase, width, height, homography.
    """
    met = beside(pool, fits.select(*CAND, "width", "height", "homography"), "frame_id", "cand").withColumn("_in", inlier())
    px, py = G.project("homography", "src_x", "src_y")
    error = G.length((px - F.col("dst_x")) * F.col("width"), (py - F.col("dst_y")) * F.col("height"))
    # a pool is bounded by its board, so its errors are one sorted array beside the counts
    judged = met.groupBy(*CAND).agg(
        F.count(F.when(F.col("_in"), 1)).alias("inliers"), F.count(F.lit(1)).alias("pool_len"),
        F.sort_array(F.collect_list(F.when(F.col("_in"), error))).alias("_errors"),
    ).where("inliers > 0")
    judged = judged.withColumn("reprojection_error", F.get("_errors", F.floor(F.size("_errors") / 2).cast("int"))).drop("_errors")
    quads = fits.withColumn("quad", board_quad("homography", "white_keys"))
    scored = quads.join(judged, CAND)
    share = F.col("inliers") / F.col("pool_len").cast("double")
    width = G.key_width("quad", "white_keys", "width", "height")
    return scored.withColumn("inlier_share", share).withColumn("key_px", width).where(
        (F.col("inlier_share") >= INLIER_SHARE) & (F.col("key_px") > 0) & (F.col("reprojection_error") < F.col("key_px") * ERROR_KEYS)
    ).where(G.quad_reason(G.quad_shape("quad")) == "")


def with_explained(fits: DataFrame, peaks: DataFrame) -> DataFrame:
    """The share of every detected corner, gap and black bottom the fit explains."""
    detected = peaks.where((F.col("channel") <= 6) | (F.col("channel") == 9)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("detected"))
    share = F.col("inliers") / F.greatest(F.coalesce("detected", F.lit(0)), F.lit(1)).cast("double")
    return fits.join(detected, "frame_id", "left").withColumn("explained", share)


def on_template(peaks: DataFrame, fits: DataFrame) -> DataFrame:
    """Peaks with where each fit's inverse puts them, as tx and ty."""
    inverse = fits.select(*CAND, "white_keys", "homography", G.invert("homography").alias("_inverse"))
    # a row a fit is kept by key, and the peaks stream past it unsorted
    met = peaks.join(inverse.hint("shuffle_hash"), "frame_id")
    x, y = G.project("_inverse", "x", "y")
    return met.withColumn("tx", x).withColumn("ty", y)


def gap_spacing(peaks: DataFrame, fits: DataFrame) -> DataFrame:
    """The median step between neighbouring gaps in template keys; absent under six steps."""
    along = on_template(peaks.where("channel = 4"), fits).where(F.abs(F.col("ty") - 1.0) < SPACING_DEPTH)
    # a fit's gaps come from one frame's score grid; the window keeps them where they are
    before = F.lag("tx").over(Window.partitionBy(*CAND).orderBy("tx", "ord"))
    step = F.col("_step")
    steps = along.select(*CAND, (F.col("tx") - before).alias("_step")).where((step > SPACING_LEAST) & (step < SPACING_MOST))
    enough = steps.groupBy(*CAND).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= SPACING_STEPS)
    return quantiles_of_few(steps, "_step", {"gap_spacing": (0.5, "upper")}, CAND).join(enough.select(*CAND), CAND, "left_semi")


def beyond_ends(peaks: DataFrame, fits: DataFrame, depth: float = dims.BLACK_DEPTH) -> DataFrame:
    """Gaps and blacks in their row but past the board's ends."""
    row = F.when(F.col("channel") == 4, 1.0).when(F.col("channel").isin(5, 6), depth)
    past = (F.col("tx") < -BEYOND_SLACK) | (F.col("tx") > F.col("white_keys") + BEYOND_SLACK)
    counted = on_template(peaks.where(F.col("channel").isin(4, 5, 6)), fits)
    return counted.groupBy(*CAND).agg(F.count(F.when((F.abs(F.col("ty") - row) < BEYOND_ROW) & past, 1)).alias("beyond_ends"))


def ends_seen(peaks: DataFrame, fits: DataFrame) -> DataFrame:
    """Whether a corner of each side was detected near where the fit puts it."""
    n, c = F.col("white_keys").cast("double"), F.col("channel")
    met = peaks.where("channel <= 3").join(fits.select(*CAND, "white_keys", "homography"), "frame_id")
    met = met.withColumn("_ex", F.when(c.isin(1, 2), n).otherwise(0.0)).withColumn("_ey", F.when(c >= 2, 1.0).otherwise(0.0))
    px, py = G.project("homography", "_ex", "_ey")
    near = G.length(px - F.col("x"), py - F.col("y")) < G.local_key_width("homography", "_ex", "_ey") * END_SLACK_KEYS
    near = F.coalesce(near, F.lit(False))
    sides = met.groupBy(*CAND).agg(F.bool_or(near & c.isin(0, 3)).alias("low_seen"), F.bool_or(near & c.isin(1, 2)).alias("high_seen"))
    return sides.withColumn("both_ends", F.col("low_seen") & F.col("high_seen"))


def fit_metrics(fits: DataFrame, peaks: DataFrame) -> DataFrame:
    """E11-E14 on accepted fits."""
    out = with_explained(fits, peaks)
    out = out.join(gap_spacing(peaks, fits), CAND, "left").join(beyond_ends(peaks, fits), CAND, "left").join(ends_seen(peaks, fits), CAND, "left")
    return out.withColumn("beyond_ends", F.coalesce("beyond_ends", F.lit(0))).withColumn("both_ends", F.coalesce("both_ends", F.lit(False)))


def is_whole_board() -> Column:
    spaced = F.abs(F.col("gap_spacing") - 1.0) < SPACING_SLACK
    return F.col("both_ends") & (F.col("beyond_ends") <= BEYOND_ALLOWED) & F.coalesce(spaced, F.lit(False))


def whole_board(fits: DataFrame) -> DataFrame:
    """A board found for the first time must show its ends and nothing past them."""
    return fits.where(F.col("locked") | is_whole_board())


def best_fit(fits: DataFrame) -> DataFrame:
    """The fit that explains most per frame, the first tried on ties."""
    rest = [c for c in fits.columns if c != "frame_id"]
    best = fits.groupBy("frame_id").agg(F.min_by(F.struct(*rest), F.struct(-F.col("explained"), F.col("cand"))).alias("b"))
    return best.select("frame_id", "b.*")


def candidate_peaks(peaks: DataFrame, plan: DataFrame) -> DataFrame:
    """Peaks of each candidate with the estimator that places them."""
    fresh = plan.where("prior_inverse is null")
    est = estimators(peaks, fresh.select(*BOARD).distinct())
    prior = F.when(F.col("prior_inverse").isNotNull(), F.array(*[at("prior_inverse", i) for i in (0, 1, 2, 6, 7, 8)]))
    # without any way to place them a candidate still has its corners
    placed = plan.join(est, BOARD, "left").withColumn("est", F.coalesce(prior, "est"))
    return placed.select(*CAND, "white_keys", "phase", "shift", "est").join(peaks, "frame_id")


def fit_frames(peaks: DataFrame, plan: DataFrame) -> DataFrame:
    """E1-E15 end to end: every acceptable fit of every candidate."""
    # made again for each reader rather than stored: the pools of all frames are large, and what they come from is not
    pool = build_pool(candidate_peaks(peaks, plan))
    refined = refine_votes(pool, vote(pool))
    fits = cut(plan.select(*CAND, "white_keys", "phase", "shift", "locked", "width", "height").join(refined, CAND))
    return whole_board(fit_metrics(cut(accept_fits(pool, fits)), peaks))
