"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
SAMPLE = 20_000
VOTERS = 256
STEMS = (4, 5)
#: Texts whose features are held at once.
ROWS = 500
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("shouting", "exclaiming")


def is_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0


def marks(text: str) -> Counter:
    """How often each possible voter's mark occurs: whole words, word beginnings, and the patterns."""
    words = Counter(WORD.findall(text.lower()))
    found: Counter = Counter()
    for word, n in words.items():
        found["=" + word] += n
        for k in STEMS:
            if len(word) > k:
                found[word[:k]] += n
    found["shouting"] = sum(len(w) > 3 and w.isupper() for w in WORD.findall(text))
    found["exclaiming"] = len(re.findall(r"[!?]{2,}", text))
    return +found


class LabelModel:
    """Two latent classes; each voter fires with its own rate in each. The label is a voter whose accuracy is
    given, so that EM cannot drift to another pair of classes.

    Voters that fire together within a class more often than independence allows share their weight: a voter counts
    1 / (1 + sum of its positive conditional correlations), so that near copies of one voter do not count twice.
    """

    def fit(self, votes: np.ndarray, label: np.ndarray, accuracy: float = 0.98, steps: int = 10) -> np.ndarray:
        said = np.where(label == 1, 1, -1) * np.log(accuracy / (1 - accuracy))
        posterior = np.where(label == 1, accuracy, 1 - accuracy)
        for _ in range(steps):
            prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
            mass = np.array([(1 - posterior).sum(), posterior.sum()])
            fire = np.stack([(1 - posterior) @ votes, posterior @ votes])
            rate = (fire + [[0.01], [0.05]]) / (mass[:, None] + 1)
            together = np.zeros((votes.shape[1],) * 2)
            for c, p in enumerate((1 - posterior, posterior)):
                centred = (votes - rate[c]) * np.sqrt(p)[:, None]
                cov = centred.T @ centred
                spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                together = np.maximum(together, np.clip(cov / np.outer(spread, spread), 0, 1))
            np.fill_diagonal(together, 0)
            weight = 1 / (1 + np.where(together > 0.2, together, 0).sum(axis=0))
            on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
            odds = np.log(prior / (1 - prior)) + said + votes @ (weight * on) + (1 - votes) @ (weight * off)
            posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return posterior


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the bias, which carries no penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x) / 100 + 1e-3)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = VOTERS) -> tuple[list[str], np.ndarray] | None:
    """The voters and the weights of the classifier; None without labels of both classes.

    Learns from at most `sample` labelled rows outside the held-out fold, those whose doc_id hashes lowest. Of several
    labels for a doc_id the higher counts; null labels and null doc_ids are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    @F.pandas_udf("array<string>")
    def voters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: sorted(marks(text)))

    seen = rows.select("y", F.explode(voters("text")).alias("mark")).groupBy("mark").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    classes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return None
    gain = F.log(((F.col("pos") + 0.5) / (classes[1] + 1)) / ((F.col("neg") + 0.5) / (classes[0] + 1)))
    best = seen.withColumn("gain", gain).where("pos >= 2 and gain > 1.5").orderBy((F.col("gain") * F.sqrt("pos")).desc(), "mark").limit(most)
    names = [r["mark"] for r in best.collect()]
    names = list(dict.fromkeys([*names, *PATTERNS]))

    counted = _counts(names)
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("y", counted("text").alias("x")).toPandas()
    x, y = np.array(table["x"].tolist(), dtype=float), table["y"].to_numpy(float)
    votes = (x > 0).astype(float)
    posterior = LabelModel().fit(votes, y)
    return names, fit_linear(_features(x), posterior)


def _features(x: np.ndarray) -> np.ndarray:
    """Each voter's logarithmic count, and how many voters speak."""
    return np.hstack([np.log1p(x), np.log1p((x > 0).sum(axis=1, keepdims=True))])


def _counts(names: list[str]):
    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_table(texts, names)))

    return counts


def _table(texts: pd.Series, names: list[str]) -> np.ndarray:
    """How often each name's mark occurs in each text. One text's marks are held at a time: a batch's would take many times its texts."""
    out = np.zeros((len(texts), len(names)), dtype=np.int32)
    for row, text in zip(out, texts):
        found = marks(text)
        row[:] = [found.get(name, 0) for name in names]
    return out


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Null text is empty, a null doc_id is not held out; without a model the score is 0."""
    text = F.coalesce(F.col("text"), F.lit(""))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        names, w = model
        odds = [_features(_table(texts[at : at + ROWS], names).astype(float)) @ w[:-1] + w[-1] for at in range(0, len(texts), ROWS)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *odds]), -30, 30))))

    rows = docs.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), score(text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
