"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.functions.lineage import cut
from tonewheel.llm import (block_names, bpe_automaton, chat, main_text, metric_tree, mix, periodic_runs, posting_blocks, quality, signature_tree,
                           token_counts, toxicity, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.join(_table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.train(pages))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.dedup(_table(spark, sf_dir, "documents")).drop("row")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.formatted_and_read(rows.unionByName(extra), _tokenizer("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"), warc.shared_folder(spark, "warc"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(quality.measured(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"))
    judged = quality.judged(rows, quality.cutoffs(rows, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "m.*", "base_failed", "kept")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.cached_counts(docs, _tokenizer("word_bpe_49k.json"), token_counts.fresh_cache(docs))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_blocks.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(_table(spark, sf_dir, "documents"), plant=True)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_main_text": op2_main_text,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat": op5_chat,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_top_k": op13_top_k,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": block_names.ORACLE,
    "op11_ranked_search": posting_blocks.ORACLE,
    "op13_top_k": metric_tree.ORACLE,
}
