"""A training corpus in five stages, from raw documents to token ids. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.functions.lineage import cut
from tonewheel.llm import block_names, bpe_automaton, mix, quality, signature_tree

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_PERCENT, NEAR_WORDS = 80, 5
ROWS_AT_ONCE = 1000


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers by 1,000 rows: ten times as many, Spark's own setting, take tens of MB on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their stratum's cutoffs reject go."""
    _small_batches(spark)
    rows = quality.measured(docs.select(*COLUMNS))
    held = cut(rows.select("doc_id", "lang", "m"))
    table = quality.cutoffs(held, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(rows, table).where("kept").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return block_names.keep_first(docs.select(*COLUMNS))


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows of a stored table with a number each: doc_ids may be null or repeated."""
    return docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by similarities of 0.8 or more on five-word shingles, the one of the smallest doc_id stays.

    A null doc_id comes after all others; of rows with one doc_id the first of the stored table stays. Rows without
    words have no near copies and stay. `docs` must be a stored table.
    """
    _small_batches(spark)
    rows = _numbered(docs)
    found = signature_tree.join(rows.select(F.col("row").alias("doc_id"), "text"), NEAR_PERCENT, NEAR_WORDS)
    later = cut(found.where("doc_id != component_id").select(F.col("doc_id").alias("row"), "component_id"))
    copies = later.unionByName(later.select(F.col("component_id").alias("row"), "component_id").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = copies.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first"))
    dropped = copies.select("row").join(first.select("first.row"), "row", "left_anti")
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its share of the mix asks: whole copies, and one more for a part taken of it.

    `docs` must be a stored table.
    """
    rows = _numbered(docs)
    copies = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    taken = mix.mix(rows, keep=("row",)).select("row", copies.alias("copies")).where("copies > 0")
    return rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids and their number."""
    import public_tokenizers

    _small_batches(spark)
    rows = bpe_automaton.encode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
