"""Exact dedup by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.lineage import cut
from tonewheel.llm.heavy import attach

BLOCK = 4096


def _named(keys: DataFrame, *order: str) -> DataFrame:
    """`keys` sorted over the cluster and numbered along that order; stored, so that a name never changes."""
    return cut(keys.orderBy(*order).withColumn("name", F.monotonically_increasing_id()))


def _block_names(docs: DataFrame, size: int) -> DataFrame:
    """digest, n, name of every distinct block. Blocks are compared whole: two under one digest stop the job."""
    blocks = docs.select(F.explode(_blocks(F.encode("text", "UTF-8"), size)).alias("block"))
    whole = blocks.groupBy(F.sha2("block", 256).alias("digest"), "block").agg(F.count("*").alias("n"))
    digests = whole.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("contents"))
    clash = F.when(F.col("contents") > 1, F.raise_error(F.lit("two blocks share a digest"))).otherwise(F.col("n"))
    return _named(digests.select("digest", clash.cast("long").alias("n")), "digest")


def _blocks(data, size: int):
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def dedup(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and row, one row for each row of `docs`.

    Null text counts as empty. Of equal texts the largest doc_id stays (null is smallest); of repeated rows with that
    id exactly one stays. `row` numbers the rows of `docs` and is stable only over a stored table. Other columns are ignored.

    Blocks of `size` bytes get integer names by sorting; then adjacent names are paired and the distinct pairs named
    the same way, until a text has a single name. Texts are equal exactly if their levels and names are.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = _block_names(docs, size)
    data = F.encode("text", "UTF-8")
    digests = F.transform(_blocks(data, size), lambda b: F.sha2(b, 256))
    leaves = cut(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), digests.alias("digests"))
    )
    blocks = leaves.select("row", F.size("digests").alias("left"), F.posexplode("digests").alias("at", "digest"))
    level, named, done = 0, cut(attach(blocks, names, "digest", "n").select("row", "left", "at", "name")), []
    while True:
        done.append(named.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
        longer = named.where("left > 1")
        if longer.isEmpty():
            break
        half = F.floor(F.col("at") / 2).cast("int")
        pairs = longer.groupBy("row", F.ceil(F.col("left") / 2).cast("int").alias("left"), half.alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut(pairs.select("row", "left", "at", F.struct("a", "b").alias("pair")))
        table = _named(pairs.groupBy("pair").agg(F.count("*").alias("n")), "pair")
        level, named = level + 1, cut(attach(pairs, table, "pair", "n").select("row", "left", "at", "name"))
    identity = done[0]
    for part in done[1:]:
        identity = identity.unionByName(part)
    rows = cut(leaves.drop("digests").join(identity, "row").withColumn("identity", F.struct("level", "name")).drop("level", "name"))
    groups = rows.groupBy("identity").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
    rows = attach(rows, cut(groups), "identity", "group_size")
    return rows.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "row"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. `docs` must be a stored table."""
    kept = dedup(docs).where("kept").select(F.col("row").alias("kept_row"))
    return docs.withColumn("kept_row", F.monotonically_increasing_id()).join(kept, "kept_row", "left_semi").select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
