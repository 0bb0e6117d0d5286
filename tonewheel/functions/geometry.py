"""Plane geometry as column expressions.

Quads are ARRAY<STRUCT<x,y>> in the order back-low, back-high, front-high, front-low; homographies
are row-major ARRAY<DOUBLE> of length 9. A division by zero gives NULL, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the keybed-shape gate.
MIN_ASPECT, MAX_ASPECT, MIN_SHORT_EDGE, MAX_END_RATIO = 1.8, 30.0, 0.01, 3.2
SINGULAR = 1e-12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def at(array, i: int) -> Column:
    return F.get(col(array), i)


def let(value: Column, fn) -> Column:
    """`fn` of a value computed once. Keeps a long chain of steps from being copied into every use."""
    return F.get(F.transform(F.array(value), fn), 0)


def once(value: Column) -> Column:
    """`value` made by a step of its own, for a column that a filter reads. The optimizer would move such a filter into the join
    below, whose condition works a value out anew at each use and soon is more code than gets compiled."""
    return F.explode(F.array(value))


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def js_round(x) -> Column:
    """Halves go up, also below zero."""
    return F.floor(col(x) + F.lit(0.5))


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def quad(*xy) -> Column:
    """A quad from eight columns x0, y0, .. x3, y3."""
    return F.array(*[point(xy[2 * i], xy[2 * i + 1]) for i in range(4)])


def length(dx: Column, dy: Column) -> Column:
    """The length of a step by the square root that the checking SQL takes: `hypot` may round its last bit the other way."""
    return F.sqrt(F.pow(dx, F.lit(2.0)) + F.pow(dy, F.lit(2.0)))


def dist(a: Column, b: Column) -> Column:
    return length(b["x"] - a["x"], b["y"] - a["y"])


def cross(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def corners_of(q) -> list[Column]:
    return [at(q, i) for i in range(4)]


def project_w(h, x, y) -> tuple[Column, Column]:
    """A point through a homography given as nine columns."""
    x, y = col(x), col(y)
    w = h[6] * x + h[7] * y + h[8]
    return div(h[0] * x + h[1] * y + h[2], w), div(h[3] * x + h[4] * y + h[5], w)


def nine(h) -> list[Column]:
    return [at(h, i) for i in range(9)]


def project(h, x, y) -> tuple[Column, Column]:
    return project_w(nine(h), x, y)


def project_point(h, x, y) -> Column:
    px, py = project(h, x, y)
    return point(px, py)


def invert(h) -> Column:
    """The inverse by cofactors, NULL when the determinant is negligible or not a number."""
    return let(col(h), _invert)


def _invert(h: Column) -> Column:
    a, b, c, d, e, f, g, k, i = nine(h)
    c00, c01, c02 = e * i - f * k, f * g - d * i, d * k - e * g
    c10, c11, c12 = c * k - b * i, a * i - c * g, b * g - a * k
    c20, c21, c22 = b * f - c * e, c * d - a * f, a * e - b * d
    det = a * c00 + b * c01 + c * c02
    cells = [c00, c10, c20, c01, c11, c21, c02, c12, c22]
    return F.when(
        (F.abs(det) > SINGULAR) & ~F.isnan(det), F.array(*[div(v, det) for v in cells])
    )


def square_to(q, white_keys=None) -> Column:
    """The homography from the unit square, or from a board `white_keys` wide, onto a quad.

    The closed form of the four-point fit; NULL where the quad has no area to map onto.
    """
    def solve(p):
        p = corners_of(p)
        x, y = [c["x"] for c in p], [c["y"] for c in p]
        ax, bx, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
        ay, by, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
        det = ax * by - bx * ay
        g, h = div(sx * by - bx * sy, det), div(ax * sy - sx * ay, det)
        n = F.lit(1.0) if white_keys is None else col(white_keys).cast("double")
        return F.when(
            g.isNotNull() & h.isNotNull(),
            F.array(
                div(x[1] - x[0] + g * x[1], n), x[3] - x[0] + h * x[3], x[0],
                div(y[1] - y[0] + g * y[1], n), y[3] - y[0] + h * y[3], y[0], div(g, n), h, F.lit(1.0),
            ),
        )

    return let(col(q), solve)


def on_square(q, p: Column) -> Column:
    """A point struct on the unit square that `square_to` maps onto a quad, by its distances from the quad's edges.

    Corners land exactly, also where three of them are collinear but for rounding, which no inverse matrix of doubles keeps.
    """
    def area(a, b, c):
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def solve(s):
        c, p = corners_of(s["q"]), s["p"]
        t012, t123, t013, t023 = area(c[0], c[1], c[2]), area(c[1], c[2], c[3]), area(c[0], c[1], c[3]), area(c[0], c[2], c[3])
        # in these orders an edge's value at a corner is that corner's triangle to the last bit, so that no two vanish together
        left, right = -area(c[0], c[3], p) * t012 * t123, area(p, c[1], c[2]) * t013 * t023
        back, front = area(c[0], c[1], p) * t023 * t123, area(p, c[2], c[3]) * t012 * t013

        def share(e):
            return F.when(e["near"] == 0, 0.0).otherwise(div(e["near"], e["near"] + e["far"]))

        return point(*[let(F.struct(n.alias("near"), f.alias("far")), share) for n, f in ((left, right), (back, front))])

    return let(F.struct(col(q).alias("q"), p.alias("p")), solve)


def lifted(h, lift, x, y) -> tuple[Column, Column]:
    """A keybed point moved up to the black keys' tops by the lift's three terms."""
    x, y, h = col(x), col(y), nine(h)
    w = h[6] * x + h[7] * y + h[8] + at(lift, 2)
    return (
        div(h[0] * x + h[1] * y + h[2] + at(lift, 0), w),
        div(h[3] * x + h[4] * y + h[5] + at(lift, 1), w),
    )


def local_key_width(h, x, y) -> Column:
    x, y = col(x), col(y)
    ax, ay = project(h, x - 0.5, y)
    bx, by = project(h, x + 0.5, y)
    return length(bx - ax, by - ay)


def key_width(q, white_keys, width=None, height=None) -> Column:
    """Mean of the back and front edge over the key count, in frame units or in pixels."""
    sx, sy = (F.lit(1.0) if width is None else col(width)), (F.lit(1.0) if height is None else col(height))

    def mean_edge(q):
        p = corners_of(q)

        def edge(a, b):
            return length((b["x"] - a["x"]) * sx, (b["y"] - a["y"]) * sy)

        return (edge(p[0], p[1]) + edge(p[3], p[2])) / F.lit(2.0)

    return div(let(col(q), mean_edge), col(white_keys).cast("double"))


def is_mirrored(q) -> Column:
    p = corners_of(q)
    return cross(p[0], p[1], p[2]) < 0


def quad_shape(q) -> Column:
    """Edge lengths, fold flag, aspect and end ratio of a quad, in one struct."""
    return let(col(q), _quad_shape)


def _quad_shape(q: Column) -> Column:
    p = corners_of(q)
    signs = [F.signum(cross(p[i], p[(i + 1) % 4], p[(i + 2) % 4])) for i in range(4)]
    edges = [dist(p[i], p[(i + 1) % 4]) for i in range(4)]
    folds = reduce(lambda a, b: a | b, [s == 0 for s in signs] + [s != signs[0] for s in signs[1:]])
    ends = (F.greatest(edges[1], edges[3]), F.least(edges[1], edges[3]))
    return F.struct(
        (F.size(col(q)) == 4).alias("four"),
        folds.alias("folds"),
        F.least(*edges).alias("shortest"),
        div((edges[0] + edges[2]) / F.lit(2.0), F.greatest((edges[1] + edges[3]) / F.lit(2.0), F.lit(MIN_SHORT_EDGE))).alias("aspect"),
        div(ends[0], F.greatest(ends[1], F.lit(MIN_SHORT_EDGE))).alias("end_ratio"),
    )


def tenths(x: Column) -> Column:
    return (js_round(x * F.lit(10.0)) / F.lit(10.0)).cast("string")


def quad_reason(shape: Column) -> Column:
    """Why a quad is not a keybed, or the empty string; the first failing rule speaks."""
    return let(shape, _quad_reason)


def _quad_reason(shape: Column) -> Column:
    return (
        F.when(~shape["four"], "needs 4 corners")
        .when(shape["folds"], "corners fold over")
        .when(shape["shortest"] < MIN_SHORT_EDGE, "corners collapsed")
        .when(
            (shape["aspect"] < MIN_ASPECT) | (shape["aspect"] > MAX_ASPECT),
            F.concat(F.lit("aspect "), tenths(shape["aspect"]), F.lit(" is not a keybed")),
        )
        .when(
            shape["end_ratio"] > MAX_END_RATIO,
            F.concat(F.lit("one end drawn "), tenths(shape["end_ratio"]), F.lit("x the other")),
        )
        .otherwise("")
    )


def straighten(x, y, k, aspect) -> tuple[Column, Column]:
    """Takes a radial lens bend out of a point in frame fractions."""
    x, y, k, aspect = col(x), col(y), col(k), col(aspect)
    dx, dy = (x - 0.5) * aspect, y - 0.5
    reach2 = (aspect * aspect + 1.0) / F.lit(4.0)
    scale = div(F.lit(1.0), F.lit(1.0) + k * div(dx * dx + dy * dy, reach2))
    return F.lit(0.5) + div(dx * scale, aspect), F.lit(0.5) + dy * scale


def straightened(p: Column, k, aspect) -> Column:
    """`straighten` on a point struct."""
    args = F.struct(p.alias("p"), col(k).alias("k"), col(aspect).alias("a"))
    return let(args, lambda s: point(*straighten(s["p"]["x"], s["p"]["y"], s["k"], s["a"])))


def bent(p: Column, k, aspect) -> Column:
    """`bend` on a point struct."""
    args = F.struct(p.alias("p"), col(k).alias("k"), col(aspect).alias("a"))
    return let(args, lambda s: point(*bend(s["p"]["x"], s["p"]["y"], s["k"], s["a"])))


def onto(h, p: Column) -> Column:
    """A point struct through a homography."""
    args = F.struct(col(h).alias("h"), p.alias("p"))
    return let(args, lambda s: point(*project(s["h"], s["p"]["x"], s["p"]["y"])))


def back(h, p: Column) -> Column:
    """A point struct through a homography's inverse; NULL coordinates where there is none."""
    return let(col(h), lambda m: onto(invert(m), p))


def bend(x, y, k, aspect) -> tuple[Column, Column]:
    """Puts the bend back; a point with no real root, or no bend to speak of, stays."""
    x, y, k, aspect = col(x), col(y), col(k), col(aspect)
    reach = F.sqrt(aspect * aspect + 1.0) / F.lit(2.0)
    dx, dy = div((x - 0.5) * aspect, reach), div(y - 0.5, reach)
    s = length(dx, dy)
    room = F.lit(1.0) - k * s * s * 4.0
    still = (s < 1e-12) | (F.abs(k) < 1e-12) | (room < 0)
    scale = div(div(F.lit(1.0) - F.sqrt(F.greatest(room, F.lit(0.0))), k * s * 2.0), s)
    return (
        F.when(still, x).otherwise(F.lit(0.5) + div(dx * scale * reach, aspect)),
        F.when(still, y).otherwise(F.lit(0.5) + dy * scale * reach),
    )
