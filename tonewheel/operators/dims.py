"""Keyboard dimensions: pitches, boards, board keys and template points (section C).

All of them are computed from a board's two attributes by expressions, so they can be derived in
place on any table that carries those, without a join.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.functions.geometry import col, js_round, point
from tonewheel.functions.lineage import grown

# The octave's layout, in white-key widths, and the standard boards.
WHITE_INDEX = [0, -1, 1, -1, 2, 3, -1, 4, -1, 5, -1, 6]
BLACK_OFFSET = [-1.0, 0.6, -1.0, 1.75, -1.0, -1.0, 3.6, -1.0, 4.63, -1.0, 5.66, -1.0]
BLACK_WIDTH = 0.58
BLACK_DEPTH = 0.62
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
LETTER_SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
STANDARD_BOARDS = [(29, "C"), (36, "C"), (45, "E"), (52, "A")]
BOARD_SIZES = [(49, 36, 84), (61, 36, 96), (76, 28, 103), (88, 21, 108)]
TEMPLATE_OCTAVE = 60
PIANO_MIDDLE = (21 + 108) / 2
CHANNELS = [
    "back-low", "back-high", "front-high", "front-low", "gaps", "black_low", "black_high",
    "black_top_low", "black_top_high", "back_gaps", "black_back_low", "black_back_high",
]
GROUPS = {"corners": (0, 3), "gaps": (4, 4), "black": (5, 6), "tops": (7, 8), "back": (9, 9), "backtops": (10, 11)}


def group_of(channel) -> Column:
    c = col(channel)
    out = F.lit(None).cast("string")
    for name, (low, high) in GROUPS.items():
        out = F.when(c.between(low, high), name).otherwise(out)
    return out


def _lookup(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _class(pitch) -> Column:
    return F.pmod(col(pitch), F.lit(12))


def _octave(pitch) -> Column:
    return F.floor(col(pitch) / F.lit(12))


def is_black(pitch) -> Column:
    return _lookup(BLACK_OFFSET, _class(pitch)) >= 0


def white_index(pitch) -> Column:
    """Whites counted from a fixed origin; meaningful for white pitches."""
    return _octave(pitch) * 7 - 12 + _lookup(WHITE_INDEX, _class(pitch))


def unit_from(pitch) -> Column:
    offset = _lookup(BLACK_OFFSET, _class(pitch))
    return F.when(offset >= 0, (_octave(pitch) * 7 - 12).cast("double") + offset).otherwise(
        white_index(pitch).cast("double")
    )


def unit_to(pitch) -> Column:
    return unit_from(pitch) + F.when(is_black(pitch), F.lit(BLACK_WIDTH)).otherwise(F.lit(1.0))


def note_name(pitch) -> Column:
    return F.concat(_lookup(NOTE_NAMES, _class(pitch)), (_octave(pitch) - 1).cast("string"))


def with_pitch_facts(df: DataFrame, pitch: str = "pitch") -> DataFrame:
    """Black flag, white index, unit span and note name of a pitch column."""
    return df.select(
        "*",
        is_black(pitch).alias("black"),
        F.when(~is_black(pitch), white_index(pitch)).alias("white_index"),
        unit_from(pitch).alias("unit_from"),
        unit_to(pitch).alias("unit_to"),
        note_name(pitch).alias("note"),
    )


def pitches(spark: SparkSession) -> DataFrame:
    """The 128 pitches."""
    return with_pitch_facts(spark.range(128).select(F.col("id").alias("pitch")))


def white_count(lowest, highest) -> Column:
    """How many whites a span of end keys holds."""
    return F.rint(unit_to(highest) - unit_from(lowest)).cast("bigint")


def boards(spark: SparkSession) -> DataFrame:
    """The standard boards, four rows."""
    return spark.createDataFrame(STANDARD_BOARDS, "white_keys int, phase string")


def standard_board_array() -> Column:
    return F.array(
        *[F.struct(F.lit(w).alias("white_keys"), F.lit(p).alias("phase")) for w, p in STANDARD_BOARDS]
    )


def letter_semitone(phase) -> Column:
    """NULL for a letter that is not a note's."""
    table = F.create_map(*[F.lit(v) for kv in LETTER_SEMITONES.items() for v in kv])
    return F.try_element_at(table, col(phase))


def first_pitch(phase) -> Column:
    return letter_semitone(phase) + TEMPLATE_OCTAVE


def lowest_pitch(phase, reach) -> Column:
    """The octave that centres the board where a full piano is centred."""
    first = letter_semitone(phase)
    return first + js_round((F.lit(PIANO_MIDDLE) - col(reach) / F.lit(2.0) - first) / F.lit(12.0)) * 12


def board_keys(df: DataFrame, depth: float = BLACK_DEPTH, near: tuple[str, float] | None = None) -> DataFrame:
    """C4: every key of each row's (white_keys, phase) board once; with `near`, a column and a
    distance, at least those with an edge that near to it."""
    first = first_pitch("phase")
    # an octave holds seven whites, so the board's last white lies within this many semitones
    reach = F.ceil(F.col("white_keys") * F.lit(12.0) / F.lit(7.0)) + 2
    low, high = F.lit(0), reach
    if near:
        within = F.lit(near[1])
        # kept about the board, so that a place at infinity lays out no key
        x = F.least(F.greatest(F.col(near[0]), -within), F.col("white_keys") + within + 1)
        low = F.greatest(low, F.floor((x - within) * F.lit(12.0 / 7.0)) - 3)
        high = F.least(high, F.ceil((x + within) * F.lit(12.0 / 7.0)) + 3)
    some = F.when(low <= high, F.sequence((F.col("_first") + low).cast("bigint"), (F.col("_first") + high).cast("bigint")))
    keys = grown(df.withColumn("_first", first).withColumn("_pitch", F.explode(some)))
    base = white_index("_first")
    black = is_black("_pitch")
    order = F.when(black, white_index(F.col("_pitch") - 1)).otherwise(white_index("_pitch")) - base
    last = F.when(black, F.col("white_keys") - 2).otherwise(F.col("white_keys") - 1)
    return (
        keys.select(
            *df.columns,
            (F.col("_pitch") - F.col("_first")).cast("int").alias("semitone"),
            black.alias("black"),
            order.cast("int").alias("white_ord"),
            (unit_from("_pitch") - base).alias("x_from"),
            (unit_from("_pitch") - base + F.when(black, F.lit(BLACK_WIDTH)).otherwise(F.lit(1.0))).alias("x_to"),
            F.when(black, F.lit(depth)).otherwise(F.lit(1.0)).alias("depth"),
            last.alias("_last"),
        )
        .where((F.col("white_ord") >= 0) & (F.col("white_ord") <= F.col("_last")))
        .drop("_last")
    )


def black_start(phase) -> Column:
    """What `black_at` needs to know of a board's first key."""
    first = first_pitch(phase)
    before = _lookup([sum(offset >= 0 for offset in BLACK_OFFSET[:i]) for i in range(12)], _class(first))
    return F.struct((_octave(first) * 7 - 12).alias("octave"), before.alias("before"), white_index(first).alias("base"))


def black_at(start, white_keys, order) -> Column:
    """Where a board's black key of this number, from 1, begins; NULL where the board has none. `template_points` the other way round."""
    keys = [i for i, offset in enumerate(BLACK_OFFSET) if offset >= 0]
    start, order = col(start), col(order)
    rank = start["before"] + order - 1
    octave, key = start["octave"] + F.floor(rank / F.lit(5)) * 7, F.pmod(rank, F.lit(5))
    below = octave + _lookup([WHITE_INDEX[i - 1] for i in keys], key) - start["base"]
    place = octave.cast("double") + _lookup([BLACK_OFFSET[i] for i in keys], key) - start["base"]
    return F.when((order >= 1) & (below <= col(white_keys) - 2), place)


def black_near(start, white_keys, x, high) -> Column:
    """The number, from 1, of the black key whose low or, where `high`, high edge is nearest to `x`, be it on the board or not."""
    start, offsets = col(start), [v for v in BLACK_OFFSET if v >= 0]
    # kept about the board, so that a place at infinity has a number
    kept = F.least(F.greatest(x, F.lit(-1.0)), col(white_keys) + F.lit(2.0))
    place = kept - F.when(high, BLACK_WIDTH).otherwise(0.0) + (start["base"] - start["octave"])
    octave = F.floor(place / F.lit(7.0))
    within = place - octave * 7
    key = F.lit(len(offsets))
    for i, (a, b) in reversed(list(enumerate(zip(offsets, [*offsets[1:], offsets[0] + 7])))):
        key = F.when(within < (a + b) / 2, i).otherwise(key)
    return octave * len(offsets) + key - start["before"] + 1


@functools.lru_cache(maxsize=64)
def black_edges(first: int, white_keys: int):
    """The black keys' low and high edges along a board of these white keys from a white pitch, for use inside a task: `board_keys` in plain numbers."""
    import numpy as np

    base = first // 12 * 7 - 12 + WHITE_INDEX[first % 12]
    low = []
    for pitch in range(first + 1, first + math.ceil(white_keys * 12 / 7) + 3):
        octave, offset = pitch // 12 * 7 - 12, BLACK_OFFSET[pitch % 12]
        if offset >= 0 and octave + WHITE_INDEX[pitch % 12 - 1] - base <= white_keys - 2:
            low.append(float(octave) + offset - base)
    low = np.array(low)
    return low, low + BLACK_WIDTH


def template_near(df: DataFrame, x: Column, channel: Column, within: float) -> DataFrame:
    """The rows of `df` with each point (`near_x`, `near_y`) of a channel of their own board less than `within` from `x`.

    Any board will do, and no table of boards is joined: an octave's seven units are its twelve
    semitones to within two, so only the keys about `x` are laid out for each row.
    """
    # columns keep to themselves, not in a struct, so that rows dealt by one of them count as dealt by it afterwards
    kept = [c for c in df.columns if c not in ("white_keys", "phase")]
    seen = df.select("white_keys", "phase", *[F.col(c).alias(f"_of_{c}") for c in kept], x.alias("_x"), channel.alias("_kind"))
    points = template_points(seen, near=("_x", within)).where((F.col("channel") == F.col("_kind")) & (F.abs(F.col("x") - F.col("_x")) < within))
    named = [F.col(c) if c not in kept else F.col(f"_of_{c}").alias(c) for c in df.columns]
    return points.select(*named, F.col("x").alias("near_x"), F.col("y").alias("near_y"))


def template_points(
    df: DataFrame, depth: Column | float = BLACK_DEPTH, near: tuple[str, float] | None = None
) -> DataFrame:
    """Each row's board as (channel, ord, x, y) points in white-key units.

    `ord` counts from 1 along the channel. Built per key by an array of that key's points; the black
    channels' order comes from the key's own pitch, so no ranking is needed.
    """
    depth = F.lit(depth) if isinstance(depth, float) else depth
    n = F.col("white_keys").cast("double")
    keys = board_keys(df, near=near)

    def entry(channel, order, x, y):
        return F.struct(
            F.lit(channel).alias("channel"), order.cast("bigint").alias("ord"), point(x, y).alias("p")
        )

    one = F.lit(1)
    ends = F.array(
        entry(0, one, F.lit(0.0), F.lit(0.0)),
        entry(1, one, n, F.lit(0.0)),
        entry(2, one, n, F.lit(1.0)),
        entry(3, one, F.lit(0.0), F.lit(1.0)),
    )
    gaps = F.array(
        entry(4, F.col("white_ord"), F.col("x_from"), F.lit(1.0)),
        entry(9, F.col("white_ord"), F.col("x_from"), F.lit(0.0)),
    )
    # blacks up to and including this one: semitones passed less the whites passed
    black_ord = F.col("semitone") - F.col("white_ord")
    blacks = F.array(
        entry(5, black_ord, F.col("x_from"), depth), entry(6, black_ord, F.col("x_to"), depth)
    )
    points = (
        F.when(F.col("black"), blacks).when(F.col("white_ord") == 0, ends).otherwise(gaps)
    )
    out = keys.select(*df.columns, F.explode(points).alias("_p"))
    return out.select(
        *df.columns, "_p.channel", "_p.ord", F.col("_p.p.x").alias("x"), F.col("_p.p.y").alias("y")
    )
