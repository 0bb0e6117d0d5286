"""Gates and keys applied as frames come in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions.geometry import col

# Fixed values of the pose lattice.
ELEVATIONS = [10, 25, 40, 55, 70]
AZIMUTHS = [-90, -60, -30, 0, 30, 60, 90]
DISTANCES = 3
VISIBLE_LEAST = 0.2


def check_quad(df: DataFrame, quad: str = "quad") -> DataFrame:
    """`usable` and the first reason a quad is not."""
    shaped = df.withColumn("_shape", G.quad_shape(quad))
    return shaped.withColumn("reason", G.quad_reason(F.col("_shape"))).withColumn(
        "usable", F.col("reason") == ""
    ).drop("_shape")


def gate_captures(df: DataFrame) -> DataFrame:
    """A snapshot with an unusable quad is dropped, a recording keeps its row without corners."""
    checked = check_quad(df)
    return checked.where((F.col("kind") == "rec") | F.col("usable")).withColumn(
        "quad", F.when(F.col("usable"), F.col("quad"))
    )


def canonical_quad(quad) -> Column:
    """Rolled by one corner where edge 0-1 is shorter than edge 0-3."""
    p = G.corners_of(quad)
    return F.when(G.dist(p[0], p[1]) >= G.dist(p[0], p[3]), col(quad)).otherwise(F.array(p[1], p[2], p[3], p[0]))


def keep_visible(df: DataFrame, least: float = VISIBLE_LEAST) -> DataFrame:
    """A10."""
    return df.where(F.col("visible_fraction") >= least)


def in_clips(stem, clips: list[str], mode: str = "contains") -> Column:
    """Whether any listed clip is in the stem, or starts it. No clips keep everything."""
    if not clips:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [getattr(col(stem), mode)(c) for c in clips])


def run_of(stem) -> Column:
    """The stem up to its last dash, or all of it."""
    s = col(stem)
    return F.when(s.contains("-"), F.regexp_extract(s, r"^(.*)-[^-]*$", 1)).otherwise(s)


def runs(frames: DataFrame) -> DataFrame:
    """Frames with their run; rows labelled as having no piano are skipped."""
    return frames.where(F.coalesce("piano", F.lit(True))).withColumn("run", run_of("stem"))


def pose_lattice(spark) -> DataFrame:
    """The 105 poses."""
    n = len(AZIMUTHS) * DISTANCES
    i = F.col("id")

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)

    return spark.range(len(ELEVATIONS) * n).select(
        pick(ELEVATIONS, F.floor(i / n)).alias("elevation"),
        pick(AZIMUTHS, F.floor(i / DISTANCES) % len(AZIMUTHS)).alias("azimuth"),
        (i % DISTANCES).cast("int").alias("distance"),
    )


def grid_coverage(frames: DataFrame) -> DataFrame:
    """Per pose, frames saved and frames skipped for showing too little of the keybed."""
    seen = frames.groupBy("elevation", "azimuth", "distance").agg(
        F.count(F.when(F.col("visible_fraction") >= VISIBLE_LEAST, 1)).alias("saved"),
        F.count(F.when(F.col("visible_fraction") < VISIBLE_LEAST, 1)).alias("skipped"),
    )
    poses = pose_lattice(frames.sparkSession)
    zero = F.lit(0)
    return poses.join(seen, ["elevation", "azimuth", "distance"], "left").select(
        "elevation", "azimuth", "distance", F.coalesce("saved", zero).alias("saved"), F.coalesce("skipped", zero).alias("skipped")
    )
