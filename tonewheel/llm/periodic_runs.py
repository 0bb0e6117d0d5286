"""Periodic runs of words by multi-scale minimizers.

A run of smallest period p has at least four periods here. At the scale of l-word grams with l/2 < p <= l, equal grams inside
the run lie whole periods apart, and the smallest gram of every window of l/2 grams recurs one period later. Two consecutive
places of one such gram at a distance in (l/2, l] therefore seed every run; comparing words at that distance extends a seed to
both sides. Periods up to SHORT are found by comparing all words at each of these distances.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORT = 4
PERIODS = 4
LEAST = 6
#: Words worked on together; a longer text is worked on alone and whole.
TOGETHER = 200_000


class _Names(dict):
    """A number for each distinct word, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _fold(a: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over each window of `width` values, by doubling the windows' width."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = fold(a[: len(a) - step], a[step:])
        have += step
    return a


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places whose gram is the least of at least one window of `window` grams."""
    if window == 1:
        return np.arange(len(grams))
    if len(grams) < window:
        return np.empty(0, np.int64)
    least = _fold(grams, window, np.minimum)
    edge = np.zeros(window - 1, grams.dtype)
    return np.flatnonzero(_fold(np.concatenate([edge, least, edge]), window, np.maximum) == grams)


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest [first, last) around `at` where every word equals the word `lag` later."""
    last, step = at, max(16, lag)
    while last < len(words) - lag:
        stop = min(last + step, len(words) - lag)
        differ = np.flatnonzero(words[last:stop] != words[last + lag : stop + lag])
        if len(differ):
            last += int(differ[0])
            break
        last, step = stop, 2 * step
    first, step = at, max(16, lag)
    while first > 0:
        stop = max(first - step, 0)
        differ = np.flatnonzero(words[stop:first] != words[stop + lag : first + lag])
        if len(differ):
            first = stop + int(differ[-1]) + 1
            break
        first, step = stop, 2 * step
    return first, last


def _short(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for lag in range(1, min(SHORT, len(words) - 1) + 1):
        same = np.concatenate([[False], words[:-lag] == words[lag:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        first, last = edges[::2], edges[1::2]
        length = last - first + lag
        for i in np.flatnonzero(length >= max(LEAST, PERIODS * lag)):
            yield int(first[i]), int(length[i]), lag


def _seeded(words: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    grams, width = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while PERIODS * (width // 2 + 1) <= longest and width < len(words):
        if width > SHORT:
            at = minimizers(grams, width // 2)
            at = at[np.argsort(grams[at], kind="stable")]
            lag = at[1:] - at[:-1]
            seeds = (grams[at[1:]] == grams[at[:-1]]) & (lag > width // 2) & (lag <= width)
            seen: dict[int, int] = {}
            for place, d in sorted(zip(at[:-1][seeds].tolist(), lag[seeds].tolist())):
                if place < seen.get(d, -1):
                    continue
                first, last = _stretch(words, place, d)
                seen[d] = last
                if last - first + d >= max(LEAST, PERIODS * d):
                    yield first, last - first + d, d
        grams = _mixed(grams[: len(grams) - width] * np.uint64(0xD6E8FEB86659FD93) + grams[width:])
        width *= 2


def runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, length, smallest period) of every run, by start, then period.

    Grams are told apart by 64-bit hashes, so a run is missed only if two different grams share one; words themselves are compared
    exactly. One stretch found with several periods keeps the smallest. `longest` is the longest text in `words`.
    """
    best: dict[tuple[int, int], int] = {}
    for start, length, period in [*_short(words), *_seeded(words, longest or len(words))]:
        best[start, length] = min(period, best.get((start, length), period))
    out = sorted((start, period, length) for (start, length), period in best.items())
    return np.array([(s, n, p) for s, p, n in out], dtype=np.int64).reshape(-1, 3)


def described(words: list[str], found: np.ndarray) -> tuple:
    """n_runs, the longest run's start, length, period and exponent, and the digests of all runs and of the kept words."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    if len(found):
        dropped = np.cumsum(change[:-1]) > 0
        words = [w for w, d in zip(words, dropped.tolist()) if not d]
        start, length, period = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        top = (start, length, period, 1000 * length // period)
    else:
        top = (None, None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    digests = (hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (listed, " ".join(words)))
    return (len(found), *top, *digests)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place after a run was planted, for the documents that get one."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def _described_all(texts: list[list[str]]) -> Iterator[tuple]:
    """Several texts at once, a word of its own between any two, which no run can hold."""
    names = _Names()
    at, parts = np.cumsum([0] + [len(t) + 1 for t in texts]), []
    for i, text in enumerate(texts):
        parts += [np.fromiter(map(names.__getitem__, text), np.int64, len(text)), np.array([-1 - i])]
    found = runs(np.concatenate(parts), max(map(len, texts)))
    owner = np.searchsorted(at, found[:, 0], side="right") - 1
    split = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        mine = found[split[i] : split[i + 1]].copy()
        mine[:, 0] -= at[i]
        yield described(text, mine)


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


def report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run and the digests of each row, every whole text in its own task's batch.

    Null and empty texts have no words, hence no run; so have texts under LEAST words. Repeated rows are reported each. With
    `plant`, some documents get a run first, by the checksum of doc_id; rows without a doc_id get none. Other columns are ignored.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [None if i is None else int(i) for i in frame["doc_id"]]
            held, size, first = [], 0, 0
            for i, (doc_id, text) in enumerate(zip(ids, frame["text"])):
                words = WORD.findall(text) if text else []
                places = planted(doc_id, len(words)) if plant else None
                held.append(words if places is None else [words[k] for k in places.tolist()])
                size += len(words)
                if size >= TOGETHER or i == len(ids) - 1:
                    rows = [(d, *r) for d, r in zip(ids[first : i + 1], _described_all(held))]
                    # dtypes first: numbers beside nulls would otherwise pass through doubles
                    yield pd.DataFrame({c: pd.array(v, dtype="object" if c.endswith("sha256") else "Int64") for c, v in zip(COLUMNS, zip(*rows))})
                    held, size, first = [], 0, i + 1

    # as text, since pandas holds a column of numbers and nulls as doubles
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(batches, SCHEMA)


COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
