from pyspark.sql import functions as F

from tonewheel.llm import mix

SCHEMA = "doc_id long, text string, source string, k string"


def test_takes_each_budget_exactly(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}", "x") for i in range(200)]
    rows += [(None, "a b", None, None), (900, None, "s0", "x"), (901, "", "empty", "x"), (5, "a b", "s1", "x"), (5, "a b", "s1", "x")]
    got = mix.mix(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(rows)
    assert got.where("taken > 3 * size or taken < 0").count() == 0
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) < 1.001 for r in per)
    assert abs(sum(r.target for r in per) - sum(r.source_size for r in per)) < 0.01


def test_empty_table(spark):
    assert mix.mix(spark.createDataFrame([], SCHEMA)).count() == 0
