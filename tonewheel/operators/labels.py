"""From key faces to role-named points, crops and training targets (section B).

A key's four corners stay together in its row as an array, so splitting and ordering them is local;
only the keyboard's axis, its ends and its gaps look across a frame's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions.geometry import at, col, div, point
from tonewheel.functions.lineage import cut, spread
from tonewheel.operators import dims
from tonewheel.operators.detect import crop_axes

# Fixed values of the label geometry and its training targets.
SAME_CORNER_PX = 1e-6
TRACK_WIDTH, TRACK_HEIGHT, SEARCH_SIZE = 768, 160, 256
STRIDE, SIGMA = 2, 1.0
RADIUS_CELLS, OFFSET_RADIUS = 3, 1
TRACKING_SHARE, PRESENCE_SHARE = 0.5, 0.2
IGNORE_ABOVE = 127


#: Distances in pixels that count as equal where rounding alone would decide.
TIE = 1e-6


def _mean(face) -> Column:
    p = G.corners_of(face)
    return point(G.total([c["x"] for c in p]) / F.lit(4.0), G.total([c["y"] for c in p]) / F.lit(4.0))


def frame_axes(keys: DataFrame) -> DataFrame:
    """B1, B2: the unit axis from the lowest white to the highest, and where the blacks lie.

    Frames with fewer than two whites give no row. One aggregate, combined before the shuffle.
    """
    white = ~F.col("black")
    p = G.corners_of("top")
    sums = {"x": G.total([c["x"] for c in p]), "y": G.total([c["y"] for c in p])}
    pitch = F.when(white, F.col("pitch"))
    # plain numbers, which aggregate by hash; structs would have every task sort its keys first
    rows = keys.select("frame_id", "black", pitch.alias("_pitch"), *[v.alias(f"_{a}") for a, v in sums.items()])
    agg = rows.groupBy("frame_id").agg(
        F.count("_pitch").alias("whites"),
        *[(f(f"_{a}", "_pitch") / F.lit(4.0)).alias(f"{n}_{a}") for n, f in (("low", F.min_by), ("high", F.max_by)) for a in sums],
        *[(F.avg(F.when(F.col("black"), F.col(f"_{a}"))) / F.lit(4.0)).alias(f"b{a}") for a in sums],
    ).where("whites >= 2")
    dx, dy = F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")
    length = G.length(dx, dy)
    return agg.select(
        "frame_id", "whites", div(dx, length).alias("kx"), div(dy, length).alias("ky"),
        F.coalesce("bx", "low_x").alias("ref_x"), F.coalesce("by", "low_y").alias("ref_y"),
    )


def _by_hash(frames: DataFrame) -> DataFrame:
    """A side of one row a frame: a task keeps its frames by key and streams the keys past them, unsorted."""
    return frames.hint("shuffle_hash")


def _along(face, ux, uy, *more) -> Column:
    """A face's corners by their place along an axis, then by their order."""
    def entry(c, i):
        return F.struct((c["x"] * ux + c["y"] * uy).alias("at"), i.alias("i"), point(c["x"], c["y"]).alias("p"), *[f(c) for f in more])

    return F.array_sort(F.transform(col(face), entry))


def split_depth(keys: DataFrame, axes: DataFrame) -> DataFrame:
    """Each white key's back and front corners, low and high side.

    The pair nearer the black keys is the back one. Pairs whose distances differ by less than TIE pixels, as on boards without
    black keys, are equally near, and then the first along the cross axis is the back one.
    """
    whites = keys.where(~F.col("black")).join(_by_hash(axes), "frame_id")
    kx, ky = F.col("kx"), F.col("ky")
    ref = F.col("ref_y") * kx - F.col("ref_x") * ky

    def pairs(across):
        def away(i):
            return F.abs((at(across, i)["at"] + at(across, i + 1)["at"]) / F.lit(2.0) - ref)

        first = away(0) <= away(2) + TIE

        def side(start):
            return _along(F.transform(F.slice(across, start, 2), lambda e: e["p"]), kx, ky)

        return F.struct(side(F.when(first, 1).otherwise(3)).alias("back"), side(F.when(first, 3).otherwise(1)).alias("front"))

    sided = whites.select("frame_id", "pitch", G.let(_along("top", -ky, kx), pairs).alias("_s"))
    return sided.select("frame_id", "pitch", *[at(f"_s.{s}", i)["p"].alias(f"{s}_{h}") for s in ("back", "front") for i, h in enumerate(("low", "high"))])


def _long(df: DataFrame, entries) -> DataFrame:
    """Rows of (frame_id, channel, idx, x_px, y_px) from (channel, idx, point) columns."""
    array = F.array(
        *[F.struct(F.lit(c).alias("channel"), i.cast("int").alias("idx"), p.alias("p")) for c, i, p in entries]
    )
    return df.select("frame_id", F.explode(array).alias("e")).where(F.col("e.p").isNotNull()).select(
        "frame_id", "e.channel", "e.idx", F.col("e.p.x").alias("x_px"), F.col("e.p.y").alias("y_px")
    )


def board_corners(white: DataFrame) -> DataFrame:
    """The board's four corners, one row per frame."""
    ends = (("back_low", F.min_by), ("back_high", F.max_by), ("front_high", F.max_by), ("front_low", F.min_by))
    found = white.groupBy("frame_id").agg(*[f(f"{n}.{a}", "pitch").alias(f"{n}_{a}") for n, f in ends for a in "xy"])
    return found.select("frame_id", *[point(f"{n}_x", f"{n}_y").alias(n) for n, _ in ends])


def corner_points(corners: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return _long(corners, [(c, zero, F.col(n)) for c, n in enumerate(("back_low", "back_high", "front_high", "front_low"))])


def _in_row(white: DataFrame) -> DataFrame:
    """Each white with its number `_i` and its next one's low corners. The window holds one frame's whites, which are at most the instrument's."""
    w = Window.partitionBy("frame_id").orderBy("pitch")
    return white.withColumn("_i", F.row_number().over(w) - 1).withColumn("_next", F.lead(F.struct("front_low", "back_low")).over(w))


def _gap_entries() -> list:
    def middle(a, b):
        return F.when(F.col("_next").isNotNull(), point((a["x"] + b["x"]) / F.lit(2.0), (a["y"] + b["y"]) / F.lit(2.0)))

    i = F.col("_i")
    return [(4, i, middle(F.col("front_high"), F.col("_next.front_low"))), (9, i, middle(F.col("back_high"), F.col("_next.back_low")))]


def gaps(white: DataFrame) -> DataFrame:
    """The midpoints between neighbouring whites at the front (4) and the back (9)."""
    return _long(_in_row(white), _gap_entries())


def white_points(white: DataFrame) -> DataFrame:
    """B5 and B6 in one pass: corners belong to a frame's first and last white."""
    first, last, zero = F.col("_i") == 0, F.col("_next").isNull(), F.lit(0)
    ends = [(c, zero, F.when(on, F.col(n))) for c, (n, on) in enumerate((("back_low", first), ("back_high", last), ("front_high", last), ("front_low", first)))]
    return _long(_in_row(white), ends + _gap_entries())


def black_fronts(keys: DataFrame, axes: DataFrame) -> DataFrame:
    """A black key's front corners on its top, on the keybed, and its top's back corners.

    Corners within a millionth of a pixel of a top corner are on the top. A key whose front does not
    split two and two gives no row.
    """
    kx, ky = F.col("kx"), F.col("ky")

    def meets(other):
        def one(c):
            return F.exists(F.col(other), lambda o: G.length(c["x"] - o["x"], c["y"] - o["y"]) < SAME_CORNER_PX).alias("meets")

        return one

    placed = keys.where(F.col("black") & F.col("front").isNotNull()).join(_by_hash(axes), "frame_id").select(
        "frame_id", "pitch", _along("front", kx, ky, meets("top")).alias("_f"), _along("top", kx, ky, meets("front")).alias("_t")
    )
    # should both front corners meet one top corner, three are left and the first two count
    parted = placed.select(
        "frame_id", "pitch", F.filter("_f", lambda e: e["meets"]).alias("top"), F.filter("_f", lambda e: ~e["meets"]).alias("bottom"),
        F.filter("_t", lambda e: ~e["meets"]).alias("back"),
    ).where(F.size("top") == 2)
    return parted.select("frame_id", "pitch", *[at(s, i)["p"].alias(f"{s}_{h}") for s in ("bottom", "top", "back") for i, h in enumerate(("low", "high"))])


def black_points(fronts: DataFrame) -> DataFrame:
    w = Window.partitionBy("frame_id").orderBy("pitch")
    rows = fronts.withColumn("_i", F.row_number().over(w) - 1)
    names = ((5, "bottom_low"), (6, "bottom_high"), (7, "top_low"), (8, "top_high"), (10, "back_low"), (11, "back_high"))
    return _long(rows, [(c, F.col("_i"), F.col(n)) for c, n in names])


def hidden_corners(corners: DataFrame, frames: DataFrame) -> DataFrame:
    """Per role corner, whether the nearest labelled corner is hidden; ties go to the lower one.

    `frames` has frame_id, corners (four points in pixels) and corner_visible; without flags nothing
    is hidden.
    """
    def hidden(role):
        r = F.col(role)
        ranked = F.transform("corners", lambda p, i: F.struct(G.length(p["x"] - r["x"], p["y"] - r["y"]).alias("d"), i.alias("i")))
        return F.coalesce(~F.get("corner_visible", F.array_min(ranked)["i"]), F.lit(False))

    met = corners.join(_by_hash(frames.select("frame_id", "corners", "corner_visible")), "frame_id", "left")
    flags = F.array(*[hidden(n) for n in ("back_low", "back_high", "front_high", "front_low")])
    return met.select("frame_id", F.posexplode(flags).alias("channel", "hidden"))


def derive_points(keys: DataFrame) -> DataFrame:
    """B1-B7 together: every derived label point of every frame with a keyboard axis."""
    axes = cut(frame_axes(keys))
    return white_points(split_depth(keys, axes)).unionByName(black_points(black_fronts(keys, axes)))


def merge_labels(derived: DataFrame, fixed: DataFrame, fixed_frames: DataFrame) -> DataFrame:
    """A corrected frame's points replace the derived ones as a whole.

    `fixed_frames` lists every frame with a correction file, also one whose points are all hidden.
    """
    cols = ["frame_id", "channel", "idx", "x_px", "y_px"]
    return derived.join(fixed_frames, "frame_id", "left_anti").select(*cols).unionByName(fixed.select(*cols))


def label_points(points: DataFrame, hidden: DataFrame) -> DataFrame:
    """The points less the hidden corners."""
    gone = hidden.where("hidden").groupBy("frame_id").agg(F.bit_or(F.expr("shiftleft(1L, channel)")).alias("_gone"))
    met = points.join(_by_hash(gone), "frame_id", "left")
    return met.where(F.expr("coalesce(_gone & shiftleft(1L, channel), 0) = 0")).drop("_gone")


def squash_crop(width, height, size: int = SEARCH_SIZE) -> Column:
    """The whole frame scaled to a square."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(div(F.lit(float(size)), width), zero, zero, zero, div(F.lit(float(size)), height), zero, zero, zero, one)


def oriented_crop(quad, width: int = TRACK_WIDTH, height: int = TRACK_HEIGHT) -> Column:
    """Frame pixels to crop pixels, keys left to right and the player's edge at the bottom."""
    def matrix(c):
        rows = [c["ax"] / c["scale"], c["ay"] / c["scale"], c["ox"] / c["scale"], c["oy"] / c["scale"]]
        zero = F.lit(0.0)
        return F.array(
            rows[0], rows[1], F.lit(width / 2.0) - (c["ax"] * c["cx"] + c["ay"] * c["cy"]) / c["scale"],
            rows[2], rows[3], F.lit(height / 2.0) - (c["ox"] * c["cx"] + c["oy"] * c["cy"]) / c["scale"], zero, zero, F.lit(1.0),
        )

    return G.let(crop_axes(quad, width, height), matrix)


def _margins(width: int, height: int) -> tuple[float, float]:
    return width * 0.08 / 1.16, height * 0.15 / 1.30


def rectified_points(quad, points, width: int = TRACK_WIDTH, height: int = TRACK_HEIGHT) -> Column:
    """Where `rectified_crop` puts an array of point structs, by the quad's edges; NULL entries when degenerate."""
    left, top = _margins(width, height)
    none = F.lit(None).cast("double")

    def placed(p):
        return G.let(G.on_square(quad, p), lambda s: point(s["x"] * (width - 2 * left) + left, s["y"] * (height - 2 * top) + top))

    sound = G.invert(G.square_to(quad)).isNotNull()
    return F.when(sound, F.transform(col(points), placed)).otherwise(F.transform(col(points), lambda p: point(none, none)))


def rectified_crop(quad, width: int = TRACK_WIDTH, height: int = TRACK_HEIGHT) -> Column:
    """The homography from a quad onto the margined rectangle, NULL when degenerate.

    Next to degenerate its doubles no longer carry points; `rectified_points` does.
    """
    left, top = _margins(width, height)
    w, h = width - 2 * left, height - 2 * top

    def placed(inv):
        r = G.nine(inv)
        rows = [r[0] * w + r[6] * left, r[1] * w + r[7] * left, r[2] * w + r[8] * left,
                r[3] * h + r[6] * top, r[4] * h + r[7] * top, r[5] * h + r[8] * top, r[6], r[7], r[8]]
        return F.when(inv.isNotNull(), F.array(*[div(v, r[8]) for v in rows]))

    return G.let(G.let(G.square_to(quad), G.invert), placed)


def clipped(ring, width, height) -> Column:
    """The part of a convex polygon inside the frame, cut by one half plane after another."""
    zero, one = F.lit(0.0), F.lit(1.0)
    w, h = col(width).cast("double"), col(height).cast("double")
    # each side of the frame as (a, b, c): inside where a x + b y + c >= 0
    sides = F.array(*[F.struct(a.alias("a"), b.alias("b"), c.alias("c")) for a, b, c in (
        (one, zero, zero), (-one, zero, w), (zero, one, zero), (zero, -one, h))])

    def cut_by(points, side):
        def room(p):
            return side["a"] * p["x"] + side["b"] * p["y"] + side["c"]

        def kept(p, i):
            q = F.get(points, (i + 1) % F.size(points))
            here, there = room(p), room(q)
            t = div(here, here - there)
            crossing = F.array(point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t))
            none = F.slice(F.array(p), 1, 0)
            return F.concat(F.when(here >= 0, F.array(p)).otherwise(none), F.when(here * there < 0, crossing).otherwise(none))

        return F.flatten(F.transform(points, kept))

    return F.aggregate(sides, col(ring), cut_by)


def ring_area(ring) -> Column:
    """The area a polygon encloses; 0 for an empty one."""
    def term(p, i):
        q = F.get(col(ring), (i + 1) % F.size(col(ring)))
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.abs(F.aggregate(F.transform(col(ring), term), F.lit(0.0), lambda a, t: a + t)) / 2.0


def presence(frames: DataFrame) -> DataFrame:
    """1 where at least a fifth of the keybed lies inside the frame, else 0.

    `frames` has frame_id, quad (pixels, NULL for a negative), keys (their number), width, height.
    """
    inside = G.let(clipped("quad", "width", "height"), ring_area)
    share = div(inside, G.let(F.col("quad"), ring_area))
    shown = F.coalesce((F.col("keys") > 0) & (share >= PRESENCE_SHARE), F.lit(False))
    return frames.select("frame_id", F.when(shown, 1.0).otherwise(0.0).alias("presence"))


def with_crop_xy(points: DataFrame) -> DataFrame:
    """Adds where `to_crop` puts each point."""
    x, y = G.project("to_crop", "x_px", "y_px")
    return points.withColumn("x_crop", x).withColumn("y_crop", y)


def _in_crop() -> Column:
    x, y = F.col("x_crop"), F.col("y_crop")
    return (x >= 0) & (x < F.col("crop_width")) & (y >= 0) & (y < F.col("crop_height"))


def tracking(frames: DataFrame, points: DataFrame) -> DataFrame:
    """1 where at least half the gaps lie in the track crop; `points` carry their crop."""
    inside = with_crop_xy(points.where("channel = 4")).groupBy("frame_id").agg(
        F.avg(_in_crop().cast("double")).alias("share")
    )
    hit = F.coalesce(F.col("share") >= TRACKING_SHARE, F.lit(False))
    return frames.join(inside, "frame_id", "left").select("frame_id", F.when(hit, 1.0).otherwise(0.0).alias("tracking"))


def with_visibility(points: DataFrame, mask_cells: DataFrame) -> DataFrame:
    """Points with `visible`: in the frame, in the crop, and not under the ignore mask.

    `points` carry width, height and their crop; a mask pixel is found at the point rounded half to
    even, and a point off the mask is not covered.
    """
    covered = mask_cells.where(F.col("value") > IGNORE_ABOVE).select(
        "frame_id", F.col("row").cast("bigint").alias("_row"), F.col("col").cast("bigint").alias("_col")
    ).distinct().withColumn("_covered", F.lit(True))
    x, y = F.col("x_px"), F.col("y_px")
    placed = with_crop_xy(points).withColumn("_row", F.rint(y).cast("bigint")).withColumn("_col", F.rint(x).cast("bigint"))
    met = placed.join(covered, ["frame_id", "_row", "_col"], "left")
    seen = (x >= 0) & (x < F.col("width")) & (y >= 0) & (y < F.col("height")) & _in_crop() & F.col("_covered").isNull()
    return met.withColumn("visible", seen).drop("_row", "_col", "_covered")


def visible_labels(points: DataFrame, mask_cells: DataFrame) -> DataFrame:
    return with_visibility(points, mask_cells).where("visible").drop("visible")


def _span(centre: Column, size: Column) -> Column:
    """The cells within the radius of a centre, clipped to the grid; empty when none."""
    low = F.greatest(F.lit(0), F.least(size, F.floor(centre - RADIUS_CELLS)))
    high = F.greatest(F.lit(0), F.least(size, F.ceil(centre + RADIUS_CELLS) + 1))
    return F.when(low < high, F.sequence(low, high - 1))


def _with_cells(points: DataFrame) -> DataFrame:
    """Adds the point's place in cells, a cell's centre being half a pixel past twice its index."""
    grid = points.withColumn("cx", F.col("x_crop") / F.lit(float(STRIDE)) - 0.25).withColumn(
        "cy", F.col("y_crop") / F.lit(float(STRIDE)) - 0.25
    )
    return grid.withColumn("_w", F.floor(F.col("crop_width") / STRIDE)).withColumn("_h", F.floor(F.col("crop_height") / STRIDE))


def _around(points: DataFrame, *values) -> DataFrame:
    """Every cell about a channel's points once, with the largest of `values` over the points about it.

    A channel's points, bounded by the instrument, stay in one row, so that only they move and no cell is kept: a cell
    comes from the first of its points. A point alone on its channel needs no search among others, which would be interpreted.
    """
    cells = spread(_with_cells(points).select("frame_id", "channel", "cx", "cy", "_w", "_h"), "frame_id", "channel")
    near = cells.groupBy("frame_id", "channel").agg(F.collect_set(F.struct("cx", "cy", "_w", "_h")).alias("_points"))
    several = F.when(F.size("_points") > 1, F.col("_points")).alias("_points")
    rows = near.select("frame_id", "channel", several, F.posexplode("_points").alias("_k", "_p"))
    rows = rows.withColumn("j", F.explode(_span(F.col("_p.cx"), F.col("_p._w"))))
    rows = rows.withColumn("i", F.explode(_span(F.col("_p.cy"), F.col("_p._h"))))

    def about(p):
        def within(at, centre, size):
            return (F.col(at) >= F.floor(centre - RADIUS_CELLS)) & (F.col(at) <= F.ceil(centre + RADIUS_CELLS)) & (F.col(at) < size)

        return within("j", p["cx"], p["_w"]) & within("i", p["cy"], p["_h"])

    alone = F.col("_points").isNull()
    earlier = F.exists(F.slice("_points", F.lit(1), F.col("_k")), about)
    rows = rows.where(alone | ~earlier)

    def largest(value):
        return F.when(alone, value(F.col("_p"))).otherwise(F.array_max(F.transform(F.filter("_points", about), value)))

    return rows.select("frame_id", "channel", "i", "j", *[largest(v).alias(n) for n, v in values])


def heat_targets(visible: DataFrame) -> DataFrame:
    """Sparse heat cells; where points overlap the larger value stays."""
    def near(p):
        return F.exp(-((F.col("j") - p["cx"]) ** 2 + (F.col("i") - p["cy"]) ** 2) / F.lit(2.0 * SIGMA * SIGMA))

    return _around(visible, ("value", near))


def weight_holes(unseen: DataFrame) -> DataFrame:
    """Cells without loss weight around each invisible point; every other cell weighs one."""
    return _around(unseen)


def mask_channels(rows: DataFrame, frames: DataFrame, mask_real_tops: bool) -> DataFrame:
    """Drops the channels a real frame's labels only guess.

    `frames` has frame_id, is_real, has_fix, has_back.
    """
    met = rows.join(frames, "frame_id")
    tops = F.lit(mask_real_tops) & F.col("is_real") & ~F.col("has_fix") & F.col("channel").isin(7, 8)
    back = F.col("is_real") & ~F.col("has_back") & F.col("channel").isin(9, 10, 11)
    return met.where(~tops & ~back).select(*rows.columns)


def offset_targets(points: DataFrame) -> DataFrame:
    """Per cell round a point, the way to the nearest point and how much it counts.

    The first point wins a tie. Cells around a point are the three by three about its rounded place.
    """
    grid = _with_cells(points)
    steps = F.sequence(F.lit(-OFFSET_RADIUS), F.lit(OFFSET_RADIUS))

    def cells(c):
        return F.transform(steps, lambda d: F.rint(F.col(c)).cast("bigint") + d)

    spread = grid.withColumn("i", F.explode(cells("cy"))).withColumn("j", F.explode(cells("cx"))).where(
        (F.col("i") >= 0) & (F.col("i") < F.col("_h")) & (F.col("j") >= 0) & (F.col("j") < F.col("_w"))
    )
    dx, dy = F.col("cx") - F.col("j"), F.col("cy") - F.col("i")
    near = F.exp(-(dx * dx + dy * dy) / F.lit(2.0 * SIGMA * SIGMA))
    best = spread.groupBy("frame_id", "channel", "i", "j").agg(
        F.max(F.struct(near.alias("weight"), (-F.col("idx")).alias("first"), dx.alias("dx"), dy.alias("dy"))).alias("b")
    )
    return best.select("frame_id", "channel", "i", "j", "b.dx", "b.dy", "b.weight")
