"""From score grids to peaks, and the gates around them (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions.geometry import col, div, point

# Fixed values of the detector's decoding.
PEAK_THRESHOLD, CORNER_THRESHOLD = 0.3, 0.15
PRESENCE_LEAST = 0.6
END_MARGIN = 0.02
PAD_ALONG, DEPTH_SLACK = 0.12, 1.25
LEAST_GAPS, LEAST_POINTS = 4, 8
BLACK_DEPTH = 0.62
TRACK_WIDTH, TRACK_HEIGHT, SEARCH_SIZE = 768, 160, 256
MARGIN_ALONG, MARGIN_ACROSS = 0.08, 0.15
BODY_SKIN, OCCLUDING = 2, (2, 4)

def neighbours() -> Column:
    return F.array(
        *[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    )


def local_maxima(cells: DataFrame, threshold, keys: list[str]) -> DataFrame:
    """Cells at or above the threshold and every neighbour; all of a plateau counts.

    Works on sparse and dense grids alike. A cell below the threshold can never beat one above it,
    so the threshold comes first; each remaining cell then offers its value to the cells around it
    and the best offer is taken, combined before the shuffle. A large grid spreads over all tasks.
    """
    kept = cells.where(F.col("value") >= threshold).select(*keys, "i", "j", "value")
    offers = kept.select(*keys, "i", "j", "value", F.explode(neighbours()).alias("_d")).select(
        *keys,
        (F.col("i") + F.col("_d.di")).alias("i"),
        (F.col("j") + F.col("_d.dj")).alias("j"),
        F.col("value").alias("_offer"),
        F.when((F.col("_d.di") == 0) & (F.col("_d.dj") == 0), F.col("value")).alias("_own"),
    )
    best = offers.groupBy(*keys, "i", "j").agg(F.max("_offer").alias("_best"), F.max("_own").alias("value"))
    return best.where(F.col("value") >= F.col("_best")).select(*keys, "i", "j", "value")


def with_row_neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Dense grid rows, one array per row, with the rows above and below.

    The row is the unit, so a grid of w columns shuffles w times fewer records than its cells. Rows
    fall into bands of 512; a row on a band's edge is also sent to the band beyond it, so no window
    grows with the grid.
    """
    band = F.floor(F.col("i") / F.lit(512))
    bands = F.array_distinct(
        F.array(band, F.floor((F.col("i") - 1) / F.lit(512)), F.floor((F.col("i") + 1) / F.lit(512)))
    )
    spread = rows.withColumn("_band", F.explode(bands))
    w = Window.partitionBy(*keys, "_band").orderBy("i")

    def beside(step):
        other = (F.lag if step < 0 else F.lead)
        return F.when(other("i").over(w) == F.col("i") + step, other("v").over(w))

    return (
        spread.select("*", beside(-1).alias("up"), beside(1).alias("down"))
        .where(F.col("_band") == band)
        .drop("_band")
    )


def grid_peaks(rows: DataFrame, threshold, keys: list[str]) -> DataFrame:
    """D1 on dense rows, keeping each peak's 3x3 neighbourhood for D2 and D3.

    Output per peak: i, j, value and `win`, nine values in row-major order, NULL outside the grid.
    """
    near = with_row_neighbours(rows, keys)
    picked = near.select(
        *keys, "i", "up", "v", "down", F.posexplode("v").alias("j", "value")
    ).where(F.col("value") >= threshold)
    cells = [
        (F.get(F.col(row), F.col("j") + dj) if dj else F.get(F.col(row), F.col("j")))
        for row in ("up", "v", "down")
        for dj in (-1, 0, 1)
    ]
    windowed = picked.select(*keys, "i", "j", "value", F.array(*cells).alias("win"))
    return windowed.where(F.col("value") >= F.array_max("win"))


def refine_centroid(peaks: DataFrame, edge: str = "zero") -> DataFrame:
    """The weighted mean of the 3x3 neighbourhood, negatives counting nothing.

    `edge` is "zero" for the runtime, where cells outside weigh nothing, or "repeat" for the
    evaluator, where the border repeats. A neighbourhood without weight leaves the peak's own cell.
    """
    filled = _edge_repeated() if edge == "repeat" else [F.coalesce(G.at("win", n), F.lit(0.0)) for n in range(9)]
    weights = [F.greatest(v, F.lit(0.0)) for v in filled]
    total = G.total(weights)
    di = G.total([weights[n] * float(n // 3 - 1) for n in range(9)])
    dj = G.total([weights[n] * float(n % 3 - 1) for n in range(9)])
    return peaks.select(
        "*",
        F.when(total > 0, F.col("i") + div(di, total)).otherwise(F.col("i").cast("double")).alias("ri"),
        F.when(total > 0, F.col("j") + div(dj, total)).otherwise(F.col("j").cast("double")).alias("rj"),
    )


def _edge_repeated() -> list[Column]:
    """The window with each missing cell taken from the nearest one inside the grid."""
    win = [G.at("win", n) for n in range(9)]

    def cell(r, c):
        # a missing row or column is replaced by the middle one, first across, then along
        return F.coalesce(win[3 * r + c], win[3 + c], win[3 * r + 1], win[4])

    return [cell(r, c) for r in range(3) for c in range(3)]


def refine_parabola(peaks: DataFrame) -> DataFrame:
    """D3: the vertex of a parabola through the logs of the peak and its neighbours."""
    log = [F.log(F.greatest(v, F.lit(1e-6))) for v in _edge_repeated()]

    def vertex(before, peak, after):
        curvature = before - peak * 2.0 + after
        shift = div((before - after) * 0.5, curvature)
        return F.when(curvature >= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), shift)))

    return peaks.select(
        "*",
        (F.col("i") + vertex(log[1], log[4], log[7])).alias("ri"),
        (F.col("j") + vertex(log[3], log[4], log[5])).alias("rj"),
    )


def refine_offset(peaks: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """The cell moved by the predicted offset, or the centroid where none was predicted."""
    met = refine_centroid(peaks).join(offsets.select(*keys, "i", "j", "dx", "dy"), [*keys, "i", "j"], "left")
    return met.withColumn("ri", F.coalesce(F.col("i") + F.col("dy"), F.col("ri"))).withColumn(
        "rj", F.coalesce(F.col("j") + F.col("dx"), F.col("rj"))
    ).drop("dx", "dy")


def peaks_to_frame(peaks: DataFrame, matrix: str = "to_frame") -> DataFrame:
    """The refined cell's centre pixel through the crop's matrix."""
    x, y = G.project(matrix, F.col("rj") * 2.0 + 0.5, F.col("ri") * 2.0 + 0.5)
    return peaks.select("*", x.alias("x"), y.alias("y"))


def assemble_peaks(peaks: DataFrame) -> DataFrame:
    """The best peak of each corner channel, the first in row-major order on ties; all of the rest.

    The best is an aggregate, combined before the shuffle.
    """
    corner = peaks.where(F.col("channel") <= 3)
    others = [c for c in peaks.columns if c not in ("frame_id", "channel")]
    best = corner.groupBy("frame_id", "channel").agg(
        F.min_by(F.struct(*others), F.struct(-F.col("value"), F.col("i"), F.col("j"))).alias("_b")
    )
    return best.select("frame_id", "channel", "_b.*").unionByName(peaks.where(F.col("channel") > 3))


def coarse_quad(peaks: DataFrame) -> DataFrame:
    """A rough keybed quad per frame around every point found, in frame fractions.

    `peaks` has frame_id, channel (corners, gaps and black bottoms), x, y, width, height. One pass
    gives counts, means and second moments, a second the extents along the axis they define. Centred
    moments would need a third pass; coordinates are taken about the frame's middle instead, which
    keeps the sums small.
    """
    half_w, half_h = F.col("width") / F.lit(2.0), F.col("height") / F.lit(2.0)
    pts = peaks.where(F.col("channel") <= 6).select(
        "frame_id", "channel", "width", "height",
        (F.col("x") * F.col("width") - half_w).alias("px"), (F.col("y") * F.col("height") - half_h).alias("py"),
    )
    gap, black = F.col("channel") == 4, F.col("channel").isin(5, 6)
    px, py = F.col("px"), F.col("py")
    n = F.count(F.lit(1))
    sums = pts.groupBy("frame_id").agg(
        n.alias("n"), F.count(F.when(gap, 1)).alias("gaps"), F.count(F.when(black, 1)).alias("blacks"),
        F.avg(px).alias("cx"), F.avg(py).alias("cy"),
        F.avg(F.when(gap, px)).alias("gx"), F.avg(F.when(gap, py)).alias("gy"),
        F.avg(F.when(black, px)).alias("bx"), F.avg(F.when(black, py)).alias("by"),
        F.var_pop(px).alias("xx"), F.var_pop(py).alias("yy"), F.covar_pop(px, py).alias("xy"),
        F.max("width").alias("w"), F.max("height").alias("h"),
    ).where((F.col("gaps") >= LEAST_GAPS) & (F.col("n") >= LEAST_POINTS) & (F.col("blacks") > 0))
    angle = F.atan2(F.col("xy") * 2.0, F.col("xx") - F.col("yy")) * 0.5
    behind = F.struct((F.col("bx") - F.col("gx")).alias("x"), (F.col("by") - F.col("gy")).alias("y"))

    def axes_of(a):
        # across points from the gaps to the blacks; along then turns to it as image x to image up
        up = F.when(behind["x"] * -F.sin(a) + behind["y"] * F.cos(a) < 0, -1.0).otherwise(1.0)
        return F.struct(
            (F.cos(a) * -up).alias("ax"), (F.sin(a) * -up).alias("ay"),
            (-F.sin(a) * up).alias("ox"), (F.cos(a) * up).alias("oy"),
        )

    axes = sums.withColumn("_axes", G.let(angle, axes_of)).select("*", "_axes.*").drop("_axes")
    along = (F.col("px") - F.col("cx")) * F.col("ax") + (F.col("py") - F.col("cy")) * F.col("ay")
    extents = (
        pts.select("frame_id", "px", "py").join(axes.select("frame_id", "cx", "cy", "ax", "ay"), "frame_id")
        .groupBy("frame_id").agg(F.min(along).alias("first"), F.max(along).alias("last"))
    )
    q = axes.join(extents, "frame_id")
    pad = (F.col("last") - F.col("first")) * PAD_ALONG
    low, high = F.col("first") - pad, F.col("last") + pad

    def on_across(x, y):
        return (F.col(x) - F.col("cx")) * F.col("ox") + (F.col(y) - F.col("cy")) * F.col("oy")

    front = on_across("gx", "gy")
    back = front + (on_across("bx", "by") - front) / F.lit(1.0 - BLACK_DEPTH) * DEPTH_SLACK

    def corner(a, c):
        x = F.col("cx") + F.col("w") / F.lit(2.0) + F.col("ax") * a + F.col("ox") * c
        y = F.col("cy") + F.col("h") / F.lit(2.0) + F.col("ay") * a + F.col("oy") * c
        return point(div(x, "w"), div(y, "h"))

    return q.select(
        "frame_id",
        F.array(corner(low, back), corner(high, back), corner(high, front), corner(low, front)).alias("quad"),
    )


def widen_quad(quad, factor: float = 1.3) -> Column:
    """The quad stretched along the keyboard about its centre."""
    p = G.corners_of(quad)
    frame = F.struct(
        (G.total([c["x"] for c in p]) / F.lit(4.0)).alias("cx"),
        (G.total([c["y"] for c in p]) / F.lit(4.0)).alias("cy"),
        (p[1]["x"] - p[0]["x"] + p[2]["x"] - p[3]["x"]).alias("dx"),
        (p[1]["y"] - p[0]["y"] + p[2]["y"] - p[3]["y"]).alias("dy"),
    )

    def stretch(f):
        length2 = f["dx"] * f["dx"] + f["dy"] * f["dy"]
        length2 = F.when(length2 == 0, F.lit(1.0)).otherwise(length2)

        def moved(c):
            along = ((c["x"] - f["cx"]) * f["dx"] + (c["y"] - f["cy"]) * f["dy"]) / length2
            step = along * F.lit(factor - 1.0)
            return point(c["x"] + f["dx"] * step, c["y"] + f["dy"] * step)

        return F.transform(col(quad), moved)

    return G.let(frame, stretch)


def crop_axes(quad, width: float, height: float) -> Column:
    """Centre, axes and scale of the oriented crop around a quad given in pixels."""
    p = G.corners_of(quad)
    dx = p[1]["x"] - p[0]["x"] + p[2]["x"] - p[3]["x"]
    dy = p[1]["y"] - p[0]["y"] + p[2]["y"] - p[3]["y"]
    # in the corners' order, as the checking SQL adds them: next to zero the order decides the side
    depth_x = -p[0]["x"] - p[1]["x"] + p[2]["x"] + p[3]["x"]
    depth_y = -p[0]["y"] - p[1]["y"] + p[2]["y"] + p[3]["y"]

    def named(**columns):
        return F.struct(*[v.alias(k) for k, v in columns.items()])

    def unit(v):
        length = G.length(v["x"], v["y"])
        length = F.when(length == 0, F.lit(1.0)).otherwise(length)
        return named(x=v["x"] / length, y=v["y"] / length, dx=v["dx"], dy=v["dy"])

    def sided(a):
        side = F.when(a["x"] * a["dy"] - a["y"] * a["dx"] < 0, -1.0).otherwise(1.0)
        return named(
            ax=a["x"], ay=a["y"], ox=-a["y"] * side, oy=a["x"] * side,
            cx=G.total([c["x"] for c in p]) / F.lit(4.0), cy=G.total([c["y"] for c in p]) / F.lit(4.0),
        )

    def scaled(a):
        def spread(ux, uy):
            values = [(c["x"] - a["cx"]) * ux + (c["y"] - a["cy"]) * uy for c in p]
            return F.greatest(*values) - F.least(*values)

        along = spread(a["ax"], a["ay"])
        across = spread(a["ox"], a["oy"]) + along * MARGIN_ACROSS
        scale = F.greatest(along * (1 + 2 * MARGIN_ALONG) / F.lit(float(width)), across / F.lit(float(height)), F.lit(1e-6))
        return named(scale=scale, **{k: a[k] for k in ("cx", "cy", "ax", "ay", "ox", "oy")})

    return G.let(G.let(G.let(named(x=dx, y=dy, dx=depth_x, dy=depth_y), unit), sided), scaled)


def ends_inside(fit_quad, crop) -> Column:
    """Whether every corner of a fit lies inside the track crop along it, clear of its edges.

    `fit_quad` is in pixels and `crop` the struct of `crop_axes`.
    """
    c = col(crop)

    def inside(p):
        x = F.lit(TRACK_WIDTH / 2.0) + div((p["x"] - c["cx"]) * c["ax"] + (p["y"] - c["cy"]) * c["ay"], c["scale"])
        return (x >= TRACK_WIDTH * END_MARGIN) & (x <= TRACK_WIDTH * (1.0 - END_MARGIN))

    return F.forall(col(fit_quad), inside)


def presence_gate(frames: DataFrame, least: float = PRESENCE_LEAST) -> DataFrame:
    """D9."""
    return frames.where(F.col("presence") >= least)


def hand_boxes(landmarks: DataFrame, padding: float) -> DataFrame:
    """A padded box per hand; bounds start from the frame, so they are clamped one-sidedly."""
    box = landmarks.groupBy("frame_id", "hand").agg(
        F.least(F.lit(1.0), F.min("x")).alias("x0"), F.least(F.lit(1.0), F.min("y")).alias("y0"),
        F.greatest(F.lit(0.0), F.max("x")).alias("x1"), F.greatest(F.lit(0.0), F.max("y")).alias("y1"),
    )
    pad_x, pad_y = (F.col("x1") - F.col("x0")) * padding, (F.col("y1") - F.col("y0")) * padding
    return box.select(
        "frame_id", "hand",
        (F.col("x0") - pad_x).alias("x0"), (F.col("y0") - pad_y).alias("y0"),
        (F.col("x1") + pad_x).alias("x1"), (F.col("y1") + pad_y).alias("y1"),
    )


def skin_coverage(mask: DataFrame, boxes: DataFrame, width: int, height: int, tile: int = 16) -> DataFrame:
    """Kept skin cells over all cells, per frame; a cell in two boxes counts twice.

    Boxes are cut into tiles and meet the mask's skin cells on (frame, tile), so neither side is
    broadcast and no frame is joined all against all.
    """
    def bound(value, size, up):
        v = (F.ceil if up else F.floor)(value * F.lit(float(size)))
        return F.greatest(F.lit(0), F.least(F.lit(size), v)).cast("bigint")

    b = boxes.select(
        "frame_id", "hand",
        bound(F.col("x0"), width, False).alias("c0"), bound(F.col("x1"), width, True).alias("c1"),
        bound(F.col("y0"), height, False).alias("r0"), bound(F.col("y1"), height, True).alias("r1"),
    ).where((F.col("c0") < F.col("c1")) & (F.col("r0") < F.col("r1")))

    def tiles(low, high):
        return F.explode(F.sequence(F.floor(F.col(low) / F.lit(tile)), F.floor((F.col(high) - 1) / F.lit(tile))))

    b = b.withColumn("_tx", tiles("c0", "c1")).withColumn("_ty", tiles("r0", "r1"))
    skin = mask.where(F.col("category") == BODY_SKIN).select(
        "frame_id", "row", "col",
        F.floor(F.col("col") / F.lit(tile)).alias("_tx"), F.floor(F.col("row") / F.lit(tile)).alias("_ty"),
    )
    kept = (
        skin.join(b, ["frame_id", "_tx", "_ty"])
        .where("col >= c0 and col < c1 and row >= r0 and row < r1")
        .groupBy("frame_id").agg(F.count(F.lit(1)).alias("kept"))
    )
    cells = mask.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"))
    return cells.join(kept, "frame_id", "left").select(
        "frame_id", "cells", F.coalesce("kept", F.lit(0)).alias("kept"),
        div(F.coalesce("kept", F.lit(0)).cast("double"), F.col("cells").cast("double")).alias("coverage"),
    )


def occluders(mask: DataFrame) -> DataFrame:
    """Skin and clothes cells, which hide the keys."""
    return mask.where(F.col("category").isin(*OCCLUDING))


def score_images(images: DataFrame, predictor, channels: int) -> DataFrame:
    """A caller's predictor over an image table, in Arrow batches.

    `predictor(batch)` takes an array (n, h, w, 3) and gives heat (n, channels, h/2, w/2); `images`
    has frame_id, height, width and flat pixel values. Output is one grid row per record.
    """
    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for (h, w), part in pdf.groupby(["height", "width"], sort=False):
                pixels = np.stack([np.asarray(p, dtype=np.float32) for p in part["pixels"]])
                heat = np.asarray(predictor(pixels.reshape(len(part), h, w, -1)))
                for n, frame_id in enumerate(part["frame_id"]):
                    for c in range(channels):
                        for i, row in enumerate(heat[n, c]):
                            out.append((frame_id, c, i, row.astype(float).tolist()))
            yield pd.DataFrame(out, columns=["frame_id", "channel", "i", "v"])

    return images.select("frame_id", "height", "width", "pixels").mapInPandas(
        run, "frame_id bigint, channel int, i int, v array<double>"
    )
