"""Token counts through a digest cache: only texts without a stored count are encoded."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.lineage import checkpoint_dir, cut
from tonewheel.llm.heavy import attach

#: Words whose counts a worker keeps; at this many it starts anew.
WORDS_KEPT = 400_000
SCHEMA = "text_digest string, version string, n_tokens long"


def version(path: str) -> str:
    """The digest of a tokenizer file: another file never meets the counts of this one."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class WordCounts(dict):
    """The number of tokens of each word of a text in UTF-8, for tokenizers whose pieces end at white space and leave it out."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, word: bytes) -> int:
        count = len(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False))
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = count
        return count

    def of(self, text: str) -> int:
        """The tokens of a whole text: those of what stands between spaces, tabs and line ends, which no piece contains."""
        return sum(map(self.__getitem__, text.encode("utf-8").split()))


@functools.cache
def word_counts(path: str, mark: str) -> WordCounts:
    """One for each tokenizer in a worker, kept from task to task; `mark` is the file's digest."""
    return WordCounts(path)


def cached_counts(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; a null text counts as empty, repeated rows count apart.

    `cache` is a Parquet folder that all machines share; an absent one counts as empty. Misses are told apart by
    SHA-256 of the whole text, encoded once each and appended before the join. The tokenizer must leave out white space and end its
    pieces there, as `word_bpe_49k.json` does: a text's count is then the sum of its words'.
    """
    spark, mark = docs.sparkSession, version(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_digest"))
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        rows = spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == mark)
        return rows.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_counts(path, mark)
        for batch in batches:
            counts = [known.of(text) for text in batch["text"]]
            yield pd.DataFrame({"text_digest": batch["text_digest"], "version": mark, "n_tokens": counts})

    digests = keyed.select("text_digest", "text").join(stored(), "text_digest", "left_anti")
    misses = digests.groupBy("text_digest").agg(F.first("text").alias("text"))
    misses.mapInPandas(encode, SCHEMA).write.mode("append").parquet(cache)
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text_digest")
    held = rows.groupBy("text_digest").agg(F.count("*").alias("copies"))
    # one text may make up a large part of all rows
    counted = attach(rows, cut(held.join(stored(), "text_digest")), "text_digest", "copies")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(docs: DataFrame) -> str:
    """A new cache folder under spark.checkpoint.dir."""
    return f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
