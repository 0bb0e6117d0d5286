"""Score documents of any depth and entry names of any length."""

import json

from pyspark.sql import functions as F

from tonewheel.operators import evaluate


def test_scores_of_any_depth(spark):
    deep, path = 7.5, []
    for k in range(9, 0, -1):
        deep, path = {f"k{k}": deep, "n": k}, [f"k{k}", *path]
    docs = spark.createDataFrame([("model-a x " + "v" * (1 << 20) + "w", json.dumps(deep)), ("model-a", "{}"), ("model-b", "3")], "entry string, doc string")
    docs = docs.select("entry", F.parse_json("doc").alias("score"))
    got = {r.path: r.value for r in evaluate.flatten_metrics(docs).where("entry like 'model-a%'").collect()}
    assert got == {"/".join(path): 7.5} | {"/".join([*path[:k - 1], "n"]): float(k) for k in range(1, 10)}
    assert evaluate.flatten_metrics(docs.limit(0)).count() == 0
    named = evaluate.model_metrics(docs, "model-a", "clips").where("value = 1").first()
    assert named.path == "clips/" + "v" * (1 << 20) + "w/n"
