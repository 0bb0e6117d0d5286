"""Steadiness of drawn outlines and how well they cover the picture."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions.geometry import col, div
from tonewheel.functions.lineage import cut
from tonewheel.functions.quantiles import quantiles
from tonewheel.functions.scans import numbered

# Fixed values of the steadiness report.
EVEN_POINTS, JUMP_PX, HISTORY = 40, 1.0, 300
CHUNK = 4096


def rolling_latency(lines: DataFrame, keys: list[str], order: list[str], value: str, size: int = HISTORY) -> DataFrame:
    """mean and length of the last `size` readings of each key, at every reading.

    Rows are cut into chunks; the tail of a chunk is also sent to the next one, so each window sees
    the history it needs and no key is held by one task.
    """
    placed = numbered(lines, keys, order, "_pos")
    length = max(CHUNK, size)
    chunk = F.floor((F.col("_pos") - 1) / length)
    tail = (F.col("_pos") - 1) % length >= length - (size - 1)
    spread = placed.withColumn("_own", chunk).withColumn(
        "_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(size - 1), 0)
    out = spread.withColumn("mean_ms", F.avg(value).over(w)).withColumn("held", F.count(value).over(w))
    return out.where(F.col("_chunk") == F.col("_own")).drop("_pos", "_own", "_chunk")


def _even(bars, count: int):
    """`count` points round each of n closed outlines of m corners (n, m, 2): every corner, the rest
    spread by edge length, what is left over going to the largest remainders."""
    import numpy as np

    n, m, _ = bars.shape
    ends = np.roll(bars, -1, axis=1)
    lengths = np.hypot(*np.moveaxis(ends - bars, -1, 0))
    perimeter = lengths.sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        share = np.where(perimeter == 0, 1.0, 1.0 + (count - m) * lengths / perimeter)
    base = np.floor(share)
    left = count - base.sum(axis=1, keepdims=True)
    rank = np.argsort(np.argsort(-(share - base), axis=1, kind="stable"), axis=1, kind="stable")
    parts = (base + left // m + (rank < left % m)).astype(int).ravel()
    edge = np.repeat(np.arange(n * m), parts)
    step = np.arange(len(edge)) - np.repeat(np.cumsum(parts) - parts, parts)
    t = (step / parts[edge])[:, None]
    a, b = bars.reshape(-1, 2)[edge], ends.reshape(-1, 2)[edge]
    return (a + (b - a) * t).reshape(n, count, 2)


def _moves(even, before):
    """Each even point's distance (n, count) to the nearest edge of the outline before (n, m, 2)."""
    import numpy as np

    a = before[:, None]
    d = np.roll(before, -1, axis=1)[:, None] - a
    p = even[:, :, None] - a
    with np.errstate(all="ignore"):
        t = np.nan_to_num((p * d).sum(-1) / (d * d).sum(-1)).clip(0.0, 1.0)
    return np.hypot(*np.moveaxis(d * t[..., None] - p, -1, 0)).min(axis=2)


def _by_shape(columns, work):
    """`work` on outlines batched by their corner counts, as one result per row in order."""
    import numpy as np
    import pandas as pd

    sizes = pd.Series(list(zip(*[c.map(len) for c in columns])))
    out: list = [None] * len(sizes)
    for _, rows in sizes.groupby(sizes).groups.items():
        made = work(*[np.stack(c.iloc[rows].to_list()) for c in columns])
        for i, r in zip(rows, made):
            out[i] = r
    return pd.Series(out)


def _axis(bar: str, axis: str) -> Column:
    return F.transform(bar, lambda p: p[axis])


def resample(outlines: DataFrame, count: int = EVEN_POINTS) -> DataFrame:
    """F16: adds even_x and even_y, `count` points round each outline; numpy on Arrow batches."""
    @F.pandas_udf("struct<even_x:array<double>,even_y:array<double>>")
    def spread(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        import numpy as np

        made = _by_shape([x, y], lambda a, b: list(_even(np.stack([a, b], axis=-1), count)))
        return pd.DataFrame({"even_x": made.map(lambda e: e[:, 0]), "even_y": made.map(lambda e: e[:, 1])})

    return outlines.withColumn("_even", spread(_axis("bar", "x"), _axis("bar", "y"))).select("*", "_even.*").drop("_even")


def move_rows(outlines: DataFrame, count: int = EVEN_POINTS) -> DataFrame:
    """F17, one row per key and frame: `moves`, each even point's distance to the outline before.

    `outlines` has clip_id, frame_index (dense), black, semitone and `bar` in pixels. The frame before
    is found by equality on its index, which spreads a long clip over the cluster.
    """
    key = ["clip_id", "black", "semitone"]
    before = outlines.select(*key, (F.col("frame_index") + 1).alias("frame_index"), F.col("bar").alias("_before"))
    met = outlines.select(*key, "frame_index", "bar").join(before, [*key, "frame_index"])

    @F.pandas_udf("array<double>")
    def measure(x: pd.Series, y: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        import numpy as np

        def work(x, y, bx, by):
            return list(_moves(_even(np.stack([x, y], axis=-1), count), np.stack([bx, by], axis=-1)))

        return _by_shape([x, y, bx, by], work)

    axes = [_axis(c, a) for c in ("bar", "_before") for a in "xy"]
    return met.select(*key, "frame_index", measure(*axes).alias("moves"))


def motion(outlines: DataFrame) -> DataFrame:
    """one row per even point."""
    rows = move_rows(outlines)
    return rows.select(*[c for c in rows.columns if c != "moves"], F.posexplode("moves").alias("pos", "move_px"))


def steadiness(outlines: DataFrame) -> DataFrame:
    """per clip, quantiles of the moves, the share of compared frames that jump, and how far key
    centres swing about their means."""
    rows = cut(move_rows(outlines))
    def two(c, places=2):
        scale = F.lit(10.0**places)
        return G.js_round(c * scale) / scale

    frames = outlines.groupBy("clip_id").agg(F.count_distinct("frame_index").alias("frames"))
    jumps = rows.groupBy("clip_id", "frame_index").agg(F.max(F.array_max("moves")).alias("_most")).groupBy("clip_id").agg(
        F.count(F.when(F.col("_most") > JUMP_PX, 1)).alias("_jumps")
    )
    q = quantiles(rows.select("clip_id", F.explode("moves").alias("move_px")), "move_px", {"move_median": (0.5, "lower"), "move_p95": (0.95, "lower"), "move_p999": (0.999, "lower")}, ["clip_id"], stored=True)

    def mean(axis):
        return F.aggregate(f"even_{axis}", F.lit(0.0), lambda a, v: a + v) / F.size(f"even_{axis}")

    centres = resample(outlines).select("clip_id", "black", "semitone", mean("x").alias("mx"), mean("y").alias("my"))
    swings = centres.groupBy("clip_id", "black", "semitone").agg(F.sqrt(F.var_pop("mx") + F.var_pop("my")).alias("swing"))
    s = quantiles(swings, "swing", {"swing_median": (0.5, "lower"), "swing_p95": (0.95, "lower")}, ["clip_id"])
    met = frames.join(jumps, "clip_id", "left").join(q, "clip_id", "left").join(s, "clip_id", "left")
    compared = F.col("frames") - 1
    jumpy = two(div(F.coalesce("_jumps", F.lit(0)).cast("double"), F.nullif(compared, F.lit(0)).cast("double")), 3)
    return met.select(
        "clip_id", "frames", *[two(F.col(c)).alias(c) for c in ("move_median", "move_p95", "move_p999", "swing_median", "swing_p95")],
        jumpy.alias("jumpy_frames"),
    )


def otsu(values: DataFrame, keys: list[str], value: str = "luma") -> DataFrame:
    """the level that best parts each group's values in two, the first on ties, 128 by default.

    The window runs over at most 256 levels.
    """
    level = F.greatest(F.lit(0), F.least(F.lit(255), G.js_round(value))).cast("int")
    hist = values.groupBy(*keys, level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    up = w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("n") * F.col("level")
    spine = hist.select(
        *keys, "level", F.sum("n").over(up).cast("double").alias("below"), F.sum(weight).over(up).cast("double").alias("below_sum"),
        F.sum("n").over(w).cast("double").alias("total"), F.sum(weight).over(w).cast("double").alias("sum"),
    )
    above = F.col("total") - F.col("below")
    apart = F.col("below_sum") / F.col("below") - div(F.col("sum") - F.col("below_sum"), above)
    between = F.coalesce(F.col("below") * above * apart * apart, F.lit(0.0))
    best = spine.withColumn("_b", between).groupBy(*keys).agg(
        F.max("_b").alias("_most"), F.min_by("level", F.struct(-F.col("_b"), F.col("level"))).alias("_level")
    )
    return best.select(*keys, F.when(F.col("_most") > 0, F.col("_level")).otherwise(128).alias("threshold"))


def luma(r, g, b) -> Column:
    return col(r) * 0.299 + col(g) * 0.587 + col(b) * 0.114


def pixel_fit(key_cells: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(share of each black key below the threshold, share of uncovered white cells at or above).

    The threshold is the keybed's own, over every cell any key covers.
    """
    cell = ["frame_id", "row", "col"]
    lit = key_cells.join(pixels.select(*cell, "luma"), cell)
    thresholds = otsu(lit.select(*cell, "luma").distinct(), ["frame_id"])
    met = lit.join(thresholds, "frame_id")
    dark = met.where("black").groupBy("frame_id", "semitone").agg(F.avg((F.col("luma") < F.col("threshold")).cast("double")).alias("dark_share"))
    covered = key_cells.where("black").select(*cell).distinct()
    seen = met.where("NOT black").join(covered, cell, "left_anti")
    frames = key_cells.select("frame_id").distinct()
    bright = seen.groupBy("frame_id").agg(F.avg((F.col("luma") >= F.col("threshold")).cast("double")).alias("b"))
    return dark, frames.join(bright, "frame_id", "left").select("frame_id", F.coalesce("b", F.lit(0.0)).alias("white_bright"))
