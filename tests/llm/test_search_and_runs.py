"""Ranked search, periodic runs and exact top-k against brute force, on nulls, ties, repeats, clashing columns and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tonewheel.functions.lineage import cut
from tonewheel.llm import metric_tree, periodic_runs, posting_blocks


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(found(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in c}
            score = sum(q * w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(found(text)).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    vocabulary = [f"t{i}" for i in range(150)] + ["ÉTÉ", "日本", "x9"]
    docs = [(1, None), (2, ""), (3, ".,! \n"), (8, "Ａ\u00a0İ_ß{|}~\x7f`@[É9"), (9, "".join(map(chr, range(0x180)))), (None, "t1 t2 T3"), (4, "t1 t2 T3"), (4, "t1 t2 T3"), (5, "t1-t1_t1"), (2**60 + 7, "日本 été ÉTÉ"), (7, "ab" * 50_000)]
    for i in range(500):
        topic = draw.randrange(10) * 15
        words = [draw.choice(vocabulary[topic : topic + 15] if draw.random() < 0.6 else vocabulary) for _ in range(draw.randrange(1, 60))]
        docs.append((10 + i, " ".join(words)))
    docs += [(1000 + i, "t5 t6 t7 common") for i in range(90)]
    items = [(1, None), (2, ""), (None, "t1 t9"), (3, "absent"), (4, "t1"), (4, "t1"), (4, "t2 t2 T2"), (5, "common t5 ÉTÉ absent 日本")]
    items += [(100 + i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 12)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("chunk, block, together", [(2048, 64, 512), (50, 4, 7)])
def test_ranked_search_equals_plain(spark, corpus, chunk, block, together):
    docs, items = corpus
    table = cut(spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in docs], "doc_id long, text string, item long, score double, block string"))
    asked = cut(spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n int"))
    got = posting_blocks.search(table, asked, 5, chunk, block, together).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == plain_search(docs, items, 5)


def test_ranked_search_of_nothing(spark, corpus):
    docs = cut(spark.createDataFrame(corpus[0], "doc_id long, text string"))
    asked = cut(spark.createDataFrame(corpus[1], "item_id long, text string"))
    assert posting_blocks.search(docs.limit(0), asked).count() == 0
    assert posting_blocks.search(docs, asked.limit(0)).count() == 0


def test_blocks_are_skipped_and_bounds_hold():
    draw = np.random.default_rng(3)
    table = np.where(draw.random((600, 40)) < 0.2, draw.integers(1, 1000, (600, 40)), 0).astype(np.int32)
    names = np.arange(40, dtype=np.int64)
    picks = [np.sort(draw.choice(40, 6, replace=False)) for _ in range(20)]
    weights = [draw.integers(1, 50, 6) for _ in picks]
    queries = posting_blocks.Queries(np.arange(20).tobytes(), posting_blocks._ends(picks), posting_blocks._all([names[p] for p in picks], np.int64),
                                     posting_blocks._all(weights, np.int64))
    of, members, maxima = posting_blocks.blocked(table, queries, 64)
    for c in queries.beside:
        rows = np.sort(np.concatenate([members[b] for b in np.flatnonzero(of == c)]))
        assert (rows == np.flatnonzero(table[:, c])).all()
    for i, found in posting_blocks.bounds(queries, of, maxima).items():
        for reach, b in found:
            assert posting_blocks.best_of(table, members[b], queries, i).max() <= reach


def plain_runs(words):
    out = []
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(6, 4 * p) and not any(words[i : i + n - q] == words[i + q : i + n] for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def noisy(draw, longest):
    words = [str(draw.randrange(draw.choice([2, 3, 40]))) for _ in range(draw.randrange(longest))]
    for _ in range(draw.randrange(3)):
        if len(words) > 8:
            a = draw.randrange(len(words))
            p = draw.randrange(1, 1 + max(1, (len(words) - a) // 4))
            for i in range(a + p, draw.randrange(a, len(words) + 1)):
                words[i] = words[i - p]
    return words


def test_runs_equal_plain_ones():
    draw = random.Random(11)
    for _ in range(600):
        words = noisy(draw, 150)
        numbers = np.array([int(w) for w in words], dtype=np.int64)
        assert [tuple(r) for r in periodic_runs.runs(numbers).tolist()] == plain_runs(words)


def test_runs_of_long_periods():
    draw = random.Random(2)
    for period in (5, 8, 9, 16, 17, 100, 1000, 1025):
        part = [draw.randrange(10**6) for _ in range(period)]
        words = np.array([-1] * 7 + (part * 5)[: 4 * period + period // 3] + [-2] * 3)
        assert (7, 4 * period + period // 3, period) in [tuple(r) for r in periodic_runs.runs(words).tolist()]
        short = np.array([-1] + (part * 4)[: 4 * period - 1] + [-2])
        assert len(periodic_runs.runs(short)) == 0


def test_report_equals_plain(spark):
    draw = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a a a a a a b"), (4, "a " * 6), (4, "a " * 6), (5, "A a " * 5), (2**60 + 7, "x y z " * 4)]
    rows += [(100 + i, " ".join(noisy(draw, 120))) for i in range(150)]
    rows.append((9, "p q r s t u v w x y " * 25_000))
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start long, runs_sha256 string")
    for plant in (False, True):
        want = []
        for i, t in rows[:-1]:
            words = (t or "").split()
            places = periodic_runs.planted(i, len(words)) if plant else None
            words = words if places is None else [words[k] for k in places]
            want.append((i, *periodic_runs.described(words, np.array(plain_runs(words), dtype=np.int64).reshape(-1, 3))))
        got = periodic_runs.report(table, plant).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got if r.doc_id != 9)
        long = next(r for r in got if r.doc_id == 9)
        assert plant or (long.start, long.length, long.period, long.exponent_milli) == (0, 250_000, 10, 25_000_000)
    assert periodic_runs.report(table.limit(0)).count() == 0


def plain_top(rows, k, every):
    whole = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in whole:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, page", [(16_384, 128), (60, 5)])
def test_top_k_equals_plain(spark, shard, page):
    draw = np.random.default_rng(8)
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(draw.normal(size=(300, 6)).astype(np.float32))]
    rows += [(2000 + i, [0.5] * 6) for i in range(120)] + [(3000 + i, [0.001 * (i % 3)] * 6) for i in range(40)]
    rows += [(4000, None), (4100, [None] + [1.0] * 5), (4200, [math.nan] * 6), (4300, [math.inf] * 6), (None, [1.0] * 6), (4400, []), (4500, []), (4600, [2.0] * 3),
             (4700, [1.0] * 3), (1000, rows[0][1]), (1100, [9.0] * 6), (5000, [-3e4] * 6), (-100, [0.0] * 6)]
    table = cut(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, region string, id int"))
    got = metric_tree.top_k(table, 10, 100, shard=shard, page=page).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 10, 100)
    assert metric_tree.top_k(table.limit(0)).count() == 0


def test_tree_leaves_distances_uncomputed():
    draw = np.random.default_rng(1)
    v = np.unique(np.floor(draw.normal(size=(6000, 3)) * 1000).astype(np.int64), axis=0)
    space = metric_tree.Space(int((v * v).sum(axis=1).max()))
    tree = metric_tree.Tree(metric_tree.pages(v, [np.array([i]) for i in range(len(v))], space, 64), 3, space)
    for i in range(0, len(v), 300):
        want = sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if j != i)[:10]
        assert tree.search(i, v[i], 10, None) == [(-s, j) for s, j in want]
    assert tree.computed < 0.3 * 20 * len(v)
