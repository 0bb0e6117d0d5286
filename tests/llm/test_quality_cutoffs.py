"""Cutoffs of languages with few labels, and the guarantee of the settings that are admitted."""

import itertools

import numpy as np
import pytest

from tonewheel.llm import quality


def test_few_labels_suffice(spark):
    texts = {1: "plain words of a text that nobody repeats or marks " + "with more of them", 0: "# $ % & * | < > some few words and so on"}
    rows = [(400 * k + i, texts[int(i >= 30)] + f" {i}", lang) for k, lang in enumerate(["en", "de", None, "es"]) for i in range(230)]
    docs = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(d, int(d % 400 >= 30)) for d, _, _ in rows] + [(None, 1)], "doc_id long, quality int")
    got = quality.judged(docs, quality.cutoffs(docs, labels)).where("not base_failed").collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id % 400 >= 30) for r in got)
    few = labels.where("doc_id % 400 < 130")
    assert quality.cutoffs(docs, few).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_setting_holds_its_test(seed):
    draw = np.random.default_rng(seed)
    shape = [len(tried) + 1 for _, tried in quality.RULES.values()]
    good, bad = np.zeros(shape, int), np.zeros(shape, int)
    np.add.at(good, tuple((draw.random((4, 2500)) < 0.004) * draw.integers(0, 6, (4, 2500))), 1)
    np.add.at(bad, tuple(draw.integers(0, 6, (4, 300))), 1)
    none = tuple(n - 1 for n in shape)
    at = quality.setting(good, bad, 0.0125, 0.03)

    def rejected(counts, s):
        return sum(int(counts[e]) for e in itertools.product(*map(range, shape)) if any(x > y for x, y in zip(e, s)))

    assert quality.tail(rejected(good, at), 2500, 0.03) <= 0.0125 / 2
    assert rejected(bad, at) > 0 and quality.setting(good * 0, bad, 0.0125, 0.03) == none
    # no setting that the test over all of them admits rejects more bad documents
    sure = [s for s in draw.integers(0, 6, (40, 4)) if quality.tail(rejected(good, s), 2500, 0.03) <= 0.0125 / 2 / 1295]
    assert all(rejected(bad, s) <= rejected(bad, at) for s in sure)
