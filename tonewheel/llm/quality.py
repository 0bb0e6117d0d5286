"""Quality rules whose cutoffs carry a guarantee: few good documents of any stratum are rejected."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.lean import lean

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RISK = 0.03
ERROR = 0.05
# Per rule: what share of a text it looks at, and the cutoffs to try, strictest first.
RULES = {
    "symbol_share": ("n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.4)),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", (0.01, 0.03, 0.06, 0.1, 0.15)),
    "dup_line_share": ("n_dup_lines / greatest(n_words, 1)", (0.005, 0.01, 0.02, 0.04, 0.08)),
    "mean_word": ("word_chars / greatest(n_words, 1)", (8.0, 9.0, 10.0, 12.0, 15.0)),
}
# The order in which rules are tightened one after the other: what good prose shows least comes first.
CHAIN = ("symbol_share", "mean_word", "dup_line_share", "repeat_share")


def measures(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated, end = 0, 0
    for i, window in enumerate(windows) if often else ():
        if window in often:
            repeated += i + WINDOW - max(i, end)
            end = i + WINDOW
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated


def measured(docs: DataFrame, out: str = "m") -> DataFrame:
    """`docs` with the struct `out` of the measures of the whole text (null: empty)."""

    @F.pandas_udf(", ".join(f"{name} long" for name in MEASURES))
    @lean
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(text) for text in texts], columns=MEASURES)

    return docs.withColumn(out, of(F.coalesce(F.col("text"), F.lit(""))))


def tail(rejected: int, n: int, risk: float) -> float:
    """P(at most `rejected` of n) where each is rejected with probability `risk`: the exact binomial p-value."""
    total, log_n = 0.0, math.lgamma(n + 1)
    for k in range(rejected, -1, -1):
        term = math.exp(log_n - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        total += term
        if term < 1e-12 * total and k < n * risk:
            break
    return min(total, 1.0)


def setting(good: np.ndarray, bad: np.ndarray, level: float, risk: float) -> tuple[int, ...]:
    """For each rule the place of its cutoff among those to try, or their number for no cutoff.

    `good` and `bad` count a stratum's labelled documents by how many cutoffs of each rule they exceed, an axis a rule.
    A setting is admitted where the exact binomial test shows that it rejects at most `risk` of the good documents. Half
    of `level` tests a fixed sequence, CHAIN rule by rule from the loosest cutoff to the strictest, up to the first
    failure; the other half is divided over all settings. All admitted ones hold together with probability 1 - level, so
    labels may choose among them: most bad documents rejected, then fewest good ones, then the strictest.
    """
    kept = {}
    for name, counts in (("good", good), ("bad", bad)):
        for axis in range(counts.ndim):
            counts = counts.cumsum(axis)
        kept[name] = counts
    n, rejected = int(good.sum()), int(good.sum()) - kept["good"]
    p = {int(k): tail(int(k), n, risk) if k < n * risk else 1.0 for k in np.unique(rejected)}
    none = tuple(size - 1 for size in good.shape)
    admitted = [s for s in np.ndindex(*good.shape) if p[int(rejected[s])] <= level / 2 / (good.size - 1)]
    at, names = list(none), list(RULES)
    for axis in map(names.index, CHAIN):
        while at[axis] > 0:
            at[axis] -= 1
            if p[int(rejected[tuple(at)])] > level / 2:
                break
            admitted.append(tuple(at))
        else:
            continue
        break
    return min(admitted, key=lambda s: (kept["bad"][s], rejected[s], sum(s), s), default=none)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum (`lang`; null is a stratum) that has a cutoff: lang and a nullable cutoff for each rule.

    The holdout is every labelled good document of `rows` (doc_id, lang, m); of several labels for a doc_id the lower
    quality counts. The rules are tested together, see `setting`, at level error / strata. So with probability
    1 - error, no stratum loses more than `risk`. Without enough labels there is no cutoff.
    """
    label = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality in (0, 1)")
    held = rows.select("doc_id", "lang", "m.*").join(label, "doc_id")
    over = [F.expr(" + ".join(f"int({share} > {c})" for c in tried)).alias(rule) for rule, (share, tried) in RULES.items()]
    stays = F.col("quality").eqNullSafe(0) & ~base_failed("n_words", "n_repeat_words")
    held = held.select("lang", "quality", stays.alias("stays"), *over)
    counted = held.groupBy("lang", *RULES).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("stays")).alias("bad"))
    strata = counted.where("good > 0").agg(F.count_distinct(F.struct("lang")).alias("strata"))
    shape = [len(tried) + 1 for _, tried in RULES.values()]

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        at = tuple(table[rule].to_numpy() for rule in RULES)
        good[at], bad[at] = table["good"], table["bad"]
        chosen = setting(good, bad, error / max(int(table["strata"].iloc[0]), 1), risk)
        found = [tried[i] if i < len(tried) else None for i, (_, tried) in zip(chosen, RULES.values())]
        return pd.DataFrame([[table["lang"].iloc[0], *found]], columns=["lang", *RULES]).astype(dict.fromkeys(RULES, float))

    # a stratum has at most one row for each setting, however many documents there are
    both = counted.join(F.broadcast(strata))
    schema = f"lang {rows.schema['lang'].dataType.simpleString()}, " + ", ".join(f"{rule} double" for rule in RULES)
    chosen = both.groupBy("lang").applyInPandas(choose, schema)
    return chosen.where(F.coalesce(*[F.col(rule) for rule in RULES]).isNotNull())


def base_failed(n: str, repeated: str):
    return (F.col(n) < 10) | (100 * F.col(repeated) > 20 * F.col(n))


def judged(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` (with lang and m) with base_failed and kept. A stratum without cutoffs loses only what fails the base."""
    table = table.select(F.col("lang").alias("cut_lang"), F.struct(*RULES).alias("cut"))
    rejected = F.lit(False)
    for rule, (share, _) in RULES.items():
        value = F.expr(re.sub(r"\b(n_\w+|word_chars)", r"m.\1", share))
        rejected = rejected | F.coalesce(value > F.col(f"cut.{rule}"), F.lit(False))
    failed = base_failed("m.n_words", "m.n_repeat_words")
    joined = rows.join(table, F.col("lang").eqNullSafe(F.col("cut_lang")), "left")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected).drop("cut_lang", "cut")
