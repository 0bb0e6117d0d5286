"""Running values along an order, without ever holding one key's rows in one task.

A key may own a third of all rows, so a plain window over the key would send those rows to one
task. Rows are cut into chunks along the order instead: a window inside each chunk, one summary row
per chunk, a window over the (far fewer) summaries, and a join that carries each chunk's past in.
The chunks of one key spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions.geometry import col

SPAN = 4096


@dataclass(frozen=True)
class Running:
    """One running value: `how` is sum, count, max, min or last (the latest non-null)."""

    alias: str
    how: str
    value: object = None
    inclusive: bool = True


def _local(spec: Running, window):
    end = 0 if spec.inclusive else -1
    rows = window.rowsBetween(Window.unboundedPreceding, end)
    if spec.how == "count":
        return F.count(F.lit(1)).over(rows)
    if spec.how == "last":
        return F.last(col(spec.value), ignorenulls=True).over(rows)
    return getattr(F, spec.how)(col(spec.value)).over(rows)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: list[Running],
    span: float = SPAN,
    reverse: bool = False,
) -> DataFrame:
    """`df` with each running value along `order` within `keys`.

    The first order column must be numeric; rows within `span` of it form a chunk. `reverse` runs
    from the end, so a `last` there is the next row's value.
    """
    if reverse:
        flipped = df.withColumn("_o0", -F.col(order[0]))
        for i, name in enumerate(order[1:], start=1):
            flipped = flipped.withColumn(f"_o{i}", -F.col(name))
        names = [f"_o{i}" for i in range(len(order))]
        return running(flipped, keys, names, outputs, span).drop(*names)
    chunked = df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(span)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    total = [Running(s.alias, s.how, s.value) for s in outputs]
    # the summaries come from the windowed rows, so both sides of the join share one shuffle of df
    local = chunked.select(
        "*",
        *[_local(s, inside).alias(f"_in_{s.alias}") for s in outputs],
        *[_local(s, inside).alias(f"_all_{s.alias}") for s in total],
        F.lead(F.lit(1)).over(inside).isNull().alias("_end"),
    )
    sums = local.where("_end").select(*keys, "_chunk", *[F.col(f"_all_{s.alias}").alias(f"_sum_{s.alias}") for s in outputs])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def carry(s: Running):
        value = F.col(f"_sum_{s.alias}")
        if s.how == "last":
            return F.last(value, ignorenulls=True).over(before)
        return getattr(F, "sum" if s.how == "count" else s.how)(value).over(before)

    carried = sums.select(*keys, "_chunk", *[carry(s).alias(f"_past_{s.alias}") for s in outputs])
    joined = local.join(carried, [*keys, "_chunk"], "inner")

    def merge(s: Running):
        here, past = F.col(f"_in_{s.alias}"), F.col(f"_past_{s.alias}")
        if s.how == "last":
            out = F.coalesce(here, past)
        elif s.how == "max":
            out = F.greatest(here, past)
        elif s.how == "min":
            out = F.least(here, past)
        else:
            zero = F.lit(0)
            out = F.coalesce(here, zero) + F.coalesce(past, zero)
        return out.alias(s.alias)

    return joined.select(*df.columns, *[merge(s) for s in outputs])


def numbered(df: DataFrame, keys: list[str], order: list[str], alias: str, span: float = SPAN) -> DataFrame:
    """A dense position from 1 within `keys`."""
    return running(df, keys, order, [Running(alias, "count")], span)


def affine(df: DataFrame, keys: list[str], order: str, gain, offset, value: str, span: int = SPAN) -> DataFrame:
    """`df` with `value`: v = gain * v + offset after each row along `order`, a dense index from 0; v starts at 0.

    Steps compose, so each row takes in the step before it, then the two before those, then the four, until it holds all
    of its chunk. The chunks' own steps are composed the same way, and what comes out of the chunk before goes in. Linear in the rows;
    a key may have `span` times 2^20 of them.
    """
    def composed(rows: DataFrame, window, most: int) -> DataFrame:
        reach = 1
        while reach < most:
            before_gain = F.lag("_gain", reach, 1.0).over(window)
            before_offset = F.lag("_offset", reach, 0.0).over(window)
            rows = rows.select(
                *[c for c in rows.columns if c not in ("_gain", "_offset")],
                (F.col("_offset") + F.col("_gain") * before_offset).alias("_offset"), (F.col("_gain") * before_gain).alias("_gain"),
            )
            reach *= 2
        return rows

    steps = df.withColumn("_gain", col(gain)).withColumn("_offset", col(offset)).withColumn("_chunk", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = composed(steps.withColumn("_last", F.lead(F.lit(1)).over(inside).isNull()), inside, span)
    along = Window.partitionBy(*keys).orderBy("_chunk")
    whole = composed(local.where("_last").select(*keys, "_chunk", "_gain", "_offset"), along, 1 << 20)
    into = whole.select(*keys, "_chunk", F.lag("_offset", 1, 0.0).over(along).alias("_in"))
    out = local.join(into, [*keys, "_chunk"])
    return out.select(*df.columns, (F.col("_offset") + F.col("_gain") * F.col("_in")).alias(value))
