"""Splits, mixtures, names and corpora (H1-H3, H7-H9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions.geometry import col, div
from tonewheel.functions.lineage import cut
from tonewheel.functions.quantiles import quantiles
from tonewheel.functions.scans import numbered
from tonewheel.operators.ingest import in_clips

# Fixed values of the dataset rules.
VAL_FRACTION, SEARCH_EVERY, METRIC_BATCH = 0.03, 4, 1000
HASH_DIGITS = 13


def seeded(seed, *parts) -> Column:
    """A 52-bit number from a seed and a text, the same in any engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    return seeded(seed, *parts).cast("double") / F.lit(float(16**HASH_DIGITS))


def split(frames: DataFrame, fraction: float = VAL_FRACTION, seed: int = 0) -> DataFrame:
    """H1: `held` marks exactly max(1, round(fraction * n)) frames, none when there is at most one.

    The frames with the smallest seeded numbers are held. The number that parts them is found by
    selection, not by sorting all frames; frames sharing it are settled by stem.
    """
    marked = cut(frames.withColumn("_h", seeded(seed, "stem")))
    cutoff = quantiles(marked, "_h", {"_cut": (fraction, "share")}, [], stored=True)
    sizes = marked.agg(F.count(F.lit(1)).alias("_n"))
    bound = sizes.join(cutoff, F.lit(True)).select(
        F.when(F.col("_n") > 1, F.greatest(F.lit(1.0), F.rint(F.col("_n") * F.lit(fraction)))).otherwise(0.0).alias("_want"), "_cut"
    )
    # one aggregate row against the frames
    met = marked.join(F.broadcast(bound), F.lit(True))
    below = met.agg(F.count(F.when(F.col("_h") < F.col("_cut"), 1)).alias("_below"))
    ties = met.where(F.col("_h") == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("stem")))
    ties = ties.select("stem", "_r")
    joined = met.join(F.broadcast(below), F.lit(True)).join(ties, "stem", "left")
    held = (F.col("_h") < F.col("_cut")) | (F.col("_r") <= F.col("_want") - F.col("_below"))
    return joined.select(*frames.columns, ((F.col("_want") > 0) & F.coalesce(held, F.lit(False))).alias("held"))


def hold_out(frames: DataFrame, clips: list[str]) -> DataFrame:
    """H2: real frames of the listed clips are held out; with no clips none are."""
    return frames.withColumn("held", in_clips("stem", clips) if clips else F.lit(False))


def manifest(frames: DataFrame, shares: dict[str, float], epochs: int, per_epoch: int, batch: int, seed: int) -> DataFrame:
    """H3: (epoch, index, source, stem, mode): a source by its share among those with frames, then a
    frame of it, evenly; every fourth step is a search step.

    `frames` has source and stem. The source counts are as many as the shares named.
    """
    spark = frames.sparkSession
    known = frames.where(F.col("source").isin(*shares))
    ranked = numbered(known.withColumn("_h", seeded(seed, "stem")), ["source"], ["_h", "stem"], "_rank", float(1 << 38))
    weights = F.create_map(*[F.lit(v) for kv in shares.items() for v in kv])
    counts = known.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.element_at(weights, F.col("source")))
    order = Window.partitionBy(F.lit(0)).orderBy("source")
    spans = counts.select(
        "source", "n",
        div(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("upto"),
    )
    table = spans.agg(F.sort_array(F.collect_list(F.struct("source", "n", "upto"))).alias("_sources"))
    draws = spark.range(epochs * per_epoch).select(
        F.floor(F.col("id") / per_epoch).alias("epoch"), (F.col("id") % per_epoch).alias("index")
    )
    drawn = draws.join(F.broadcast(table), F.lit(True)).withColumn("_u", uniform(seed, F.lit("source"), "epoch", "index"))
    # the last source takes what rounding leaves
    pick = F.coalesce(F.get(F.filter("_sources", lambda s: F.col("_u") < s["upto"]), 0), F.element_at("_sources", -1))
    chosen = drawn.withColumn("_s", pick).select(
        "epoch", "index", F.col("_s.source").alias("source"),
        (F.floor(uniform(seed, F.lit("frame"), "epoch", "index") * F.col("_s.n")) + 1).alias("_rank"),
    )
    step = F.floor(F.col("index") / batch)
    mode = F.when(step % SEARCH_EVERY == 0, "search").otherwise("track")
    return chosen.join(ranked.select("source", "_rank", "stem"), ["source", "_rank"]).select("epoch", "index", "source", "stem", mode.alias("mode"))


def frame_names(frames: DataFrame) -> DataFrame:
    """H8: the file name of a motion frame."""
    return frames.withColumn("name", F.format_string("motion-%s-%04d", F.col("sequence"), F.col("frame_index")))


def corpus(**parts: DataFrame) -> DataFrame:
    """H9: the named frame tables as one, with their source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(n)) for n, df in parts.items()])


def synthetic_validation(split_corpus: DataFrame) -> DataFrame:
    """H9: the held frames of the still and motion renders."""
    return split_corpus.where(F.col("held") & F.col("source").isin("still", "motion"))


def metric_batches(metrics: DataFrame, tags: DataFrame, now_ms: int) -> DataFrame:
    """H7: request bodies of at most a thousand metrics per run, its tags in one last body.

    `metrics` has run, ord, path, value; `tags` has run, key, value.
    """
    placed = numbered(metrics, ["run"], ["ord"], "_pos")
    item = F.struct(
        F.replace("path", F.lit(" "), F.lit("_")).alias("key"), F.col("value"), F.lit(now_ms).cast("bigint").alias("timestamp"), F.lit(0).alias("step")
    )
    bodies = placed.groupBy("run", F.floor((F.col("_pos") - 1) / METRIC_BATCH).alias("batch")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", item.alias("m")))), lambda s: s["m"]).alias("metrics")
    )
    last = bodies.groupBy("run").agg(F.max("batch").alias("batch"))
    tagged = tags.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("tags")).join(last, "run", "left")
    first = F.struct(F.col("run").alias("run_id"), "metrics")
    final = F.struct(F.col("run").alias("run_id"), "tags")
    return bodies.select("run", "batch", F.size("metrics").alias("items"), F.to_json(first).alias("body")).unionByName(
        tagged.select("run", F.coalesce(F.col("batch") + 1, F.lit(0)).alias("batch"), F.size("tags").alias("items"), F.to_json(final).alias("body"))
    )
