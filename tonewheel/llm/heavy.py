"""Joining rows to a table of keys where one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def attach(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the columns of `table`, which has one row for each value of `key` in `rows`.

    `count` is how many rows hold the key. Keys holding over 1/1000 of all rows number below 1000 by arithmetic: these
    are broadcast, and their rows never meet in one task. All other keys join by shuffle. Read `table` from storage.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    frequent = table.where(F.col(count) > total / SHARE)
    other = table.where(F.col(count) <= total / SHARE)
    marked = rows.join(F.broadcast(frequent.select(key, F.lit(True).alias("is_frequent"))), key, "left")
    hot = rows.join(F.broadcast(frequent), key)
    rest = marked.where(F.col("is_frequent").isNull()).drop("is_frequent").join(other, key)
    return hot.unionByName(rest)
