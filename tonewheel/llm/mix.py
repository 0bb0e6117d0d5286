"""Mixing sources to target weights: hash-random order in each source, prefix sums, a cut at the exact budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source (null is a source): source_size and target.

    Targets are min(most * size, level * weight) with one level for all, such that they add up to all sizes.
    The windows see one row per source, never the documents. Sources without words get 0.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    by = by.withColumn("w", F.element_at(cycle, (rank % len(weights) + 1).cast("int"))).withColumn("most", most * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    by = by.withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", F.when(F.col("most") * F.col("w_left") > F.col("w") * F.col("left"), F.col("left") / F.col("w_left")))
    first = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    capped = F.col("most") * F.col("w_left") <= F.col("w") * F.col("left")
    share = F.when(capped, F.col("most").cast("double")).otherwise(F.col("w") * first)
    return by.select("source", "source_size", share.alias("target"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns `keep` for each row; a null text has size 0, repeated rows
    count apart.

    A source's rows are ordered by md5 of doc_id (null: 'null'). Its order is cut into 4,096 hash ranges whose sums
    are added up first, so that a hot source spreads over tasks.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), key.alias("k"), *keep).withColumn("b", F.substring("k", 1, 3))
    sums = sized.groupBy("source", "b").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("b").alias("s_b"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "b").orderBy("k", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = targets(sized).withColumnRenamed("source", "t_source")
    sums = sums.join(goal, F.col("s_source").eqNullSafe(F.col("t_source")))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("b") == F.col("s_b")))
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rest = F.floor(F.col("target") - rounds * F.col("source_size")) - F.col("base") - F.col("within")
    part = F.greatest(F.lit(0), F.least(rest, F.col("size")))
    taken = F.when(F.col("source_size") > 0, rounds * F.col("size") + part).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)
