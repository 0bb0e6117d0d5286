"""Stages of the pipeline on null and repeated doc_ids, against plain versions."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from tonewheel.functions.lineage import cut
from tonewheel.llm import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, rows):
    return cut(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).coalesce(1))


def counted(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_near_dedup_decides_by_row(spark, sf):
    draw = random.Random(3)
    base = {k: [f"{k}{draw.randrange(10**6)}" for _ in range(200)] for k in "abcdef"}

    def near(k, i):
        return " ".join(w if j != i else "other" for j, w in enumerate(base[k]))

    rows = [(3, near("a", 1), "s"), (5, near("a", 2), "s"), (5, near("b", 0), "s"),  # 5 names a near copy of 3 and a clean text
            (7, near("c", 1), "s"), (7, near("c", 2), "s"),  # two near copies share one doc_id
            (None, near("d", 1), "s"), (None, near("d", 2), "s"),  # and two have none
            (None, near("e", 1), "s"), (9, near("e", 2), "s"), (None, near("f", 1), "s"),
            (3, None, "s"), (3, "", "s"), (None, None, "s")]
    groups = {}
    for at, (i, text, _) in enumerate(rows):
        groups.setdefault(text[0] if text else at, []).append((i is None, i or 0, at))
    want = Counter(rows[min(g)[2]] for g in groups.values())
    assert counted(corpus_pipeline.near_dedup(spark, stored(spark, rows), sf)) == want
    assert corpus_pipeline.near_dedup(spark, stored(spark, rows).limit(0), sf).count() == 0


def test_mix_sources_counts_each_row(spark, sf):
    rows = [(i, f"t{i} " * (1 + i % 7), f"s{i % 3}") for i in range(120)]
    rows += [(None, "n " * 4, "s0"), (None, "m " * 9, "s0"), (None, "x y", None), (4, "p " * 11, "s1"), (4, "q", "s1"), (8, None, "s1")]
    sizes = [len((t or "").split()) for _, t, _ in rows]
    sized = spark.createDataFrame([(s, n) for (_, _, s), n in zip(rows, sizes)], "source string, size long")
    goals = {r.source: (r.source_size, r.target) for r in mix.targets(sized).collect()}
    want = Counter()
    for source, (total, target) in goals.items():
        mine = [(hashlib.md5(str("null" if i is None else i).encode()).hexdigest(), n, at)
                for at, ((i, _, s), n) in enumerate(zip(rows, sizes)) if s == source]
        rounds, before = int(target // total), 0
        for _, n, at in sorted(mine):
            part = max(0, min(int(target - rounds * total) - before, n))
            want[rows[at]] += -(-(rounds * n + part) // max(n, 1))
            before += n
    got = counted(corpus_pipeline.mix_sources(spark, stored(spark, rows), sf))
    assert got == +want and any(i is None for i, _, _ in got)
