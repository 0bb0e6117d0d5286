import random

import public_tokenizers
from tokenizers import Tokenizer

from tonewheel.llm import token_counts

SCHEMA = "doc_id long, text string, version string, n_tokens long"


def test_equals_the_library_and_encodes_misses_once(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    rows = [(1, "Some words", "x", 9), (2, None, None, None), (3, "", "x", 1), (1, "Some words", "x", 9), (None, "a <|endoftext|> b", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = Tokenizer.from_file(path)
    want = sorted((len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for _, t, _, _ in rows)
    for _ in range(2):
        got = token_counts.cached_counts(docs, path, cache).collect()
        assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert spark.read.parquet(cache).count() == 3
    assert token_counts.cached_counts(docs.limit(0), path, cache).count() == 0


def test_words_add_up_to_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    counts, plain, draw = token_counts.WordCounts(path), Tokenizer.from_file(path), random.Random(9)
    marks = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u0301", "e\u0301", "É", "İ", "Σ", "ΑΣ", "ß", "日本", "🙂", "'s", "'LL", "don't",
             "12", "٣", "<|endoftext|>", "<|startoftext|>", "!?", "-", "a", "Word", "supercalifragilistic", "\x00", "\u200d", "ﬁ", "\u1100\u1161"]
    for _ in range(3000):
        text = "".join(draw.choice(marks) for _ in range(draw.randrange(12)))
        assert counts.of(text) == len(plain.encode(text, add_special_tokens=False).ids), ascii(text)
    assert counts.of("ab" * 50_000) == len(plain.encode("ab" * 50_000, add_special_tokens=False).ids)
