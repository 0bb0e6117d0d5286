"""Cutting lineage where an expensive intermediate is read more than once."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names. Where none is named a local session takes a temporary one; a cluster's machines
    would each write to their own disk, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or _scratch()


@functools.cache
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back, so losing an executor costs no rerun of
    what led to it. Kept as Parquet, so later reads still prune columns and push filters down."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all the cluster's shuffle partitions before a stage whose work is its Python or what the rows
    grow into, not their bytes: left alone, adaptive execution would merge small partitions into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def grown(df: DataFrame) -> DataFrame:
    """Rows that an explode made. The optimizer takes them for as few as before it and may broadcast all of them through the
    driver; a join that meets them, here or behind further selects and aggregates, sorts and merges instead."""
    return df.hint("merge")


def beside(rows: DataFrame, few: DataFrame, by: str, also: str) -> DataFrame:
    """`rows` with those of `few` that agree on `by` and `also`, joined on `by` alone: rows dealt by it stay where they are, while a join
    on both would deal all of them anew. The few are kept by key in each task and the rows stream past them."""
    met = rows.join(few.withColumnRenamed(also, "_also").hint("shuffle_hash"), by)
    # written as a difference, which is no further join key
    return met.where((F.col(also) - F.col("_also")) == 0).drop("_also")
