"""Scans, quantiles, averages and picks against plain Python on small fixtures with a hot key."""

import math
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonewheel.functions import picks
from tonewheel.functions.quantiles import bucket_of, counts, quantiles, quantiles_of_few
from tonewheel.functions.scans import Running, running
from tonewheel.operators import sessions


def hot(spark, n=600):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(2, 6), i, rng.choice([None, rng.uniform(-5, 5)])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, o bigint, v double")


def test_chunked_scans_equal_a_window(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("o")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "k", "o", F.coalesce(F.sum("v").over(upto), F.lit(0.0)).alias("s"), F.max("v").over(upto).alias("m"), F.count(F.lit(1)).over(upto).alias("n"),
        F.last("v", ignorenulls=True).over(before).alias("l"),
    )
    got = running(
        df, ["k"], ["o"], [Running("s", "sum", "v"), Running("m", "max", "v"), Running("n", "count"), Running("l", "last", "v", False)], span=7
    ).select("k", "o", "s", "m", "n", "l")
    key = lambda r: r["o"]
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key)):
        assert a["k"] == b["k"] and a["m"] == b["m"] and a["n"] == b["n"] and a["l"] == b["l"]
        assert math.isclose(a["s"], b["s"], abs_tol=1e-9)


def test_reverse_scan_gives_the_next_row(spark):
    df = hot(spark, 200).fillna(0.0)
    got = running(df, ["k"], ["o"], [Running("nx", "last", "v", False)], span=5, reverse=True)
    want = df.withColumn("nx", F.lead("v").over(Window.partitionBy("k").orderBy("o")))
    assert sorted(map(tuple, got.select("k", "o", "nx").collect())) == sorted(map(tuple, want.select("k", "o", "nx").collect()))


def test_quantile_rules(spark):
    rng = random.Random(5)
    groups = {g: [round(rng.uniform(-100, 100), rng.choice([0, 3])) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 501))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    rules = {"i": (0.5, "interp"), "l": (0.95, "lower"), "r": (0.95, "rank"), "t": (0.9, "trunc"), "u": (0.5, "upper")}
    for row in quantiles(df, "v", rules, ["g"]).collect():
        s = sorted(groups[row["g"]])
        n = len(s)
        assert math.isclose(row["i"], float(np.median(s)), abs_tol=1e-9)
        assert row["l"] == s[math.floor(0.95 * (n - 1))]
        assert row["r"] == s[max(math.ceil(n * 0.95), 1) - 1]
        assert row["t"] == s[min(math.floor(n * 0.9), n - 1)]
        assert row["u"] == s[n // 2]


def _sorted_at(values, q, rule):
    s = sorted(v for v in values if v is not None and not math.isnan(v))
    at = {"lower": math.floor(q * (len(s) - 1)), "upper": len(s) // 2, "rank": max(math.ceil(len(s) * q), 1) - 1}
    return s[at[rule]]


def test_quantiles_of_hard_values(spark):
    rng = random.Random(6)
    wide = [m * 10.0**e for e in range(-300, 301, 7) for m in (1.0, -1.0, 1.0 + 2**-52)]
    groups = {
        "wide": wide + [math.inf, -math.inf, 0.0, -0.0, 1.7e308, -1.7e308], "nan": [math.nan, None, 1.0, math.nan, 2.0, 3.0], "none": [math.nan, None],
        "same": [0.1] * 500, "near": [1.0 + i * 2.0**-52 for i in rng.choices(range(3000), k=2000)], "two": [5e-324, 0.0, 1e-320],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    rules = {"l": (0.95, "lower"), "u": (0.5, "upper"), "r": (0.1, "rank")}
    want = {g: tuple(_sorted_at(vs, q, rule) for q, rule in rules.values()) for g, vs in groups.items() if g != "none"}
    assert {r["g"]: (r["l"], r["u"], r["r"]) for r in quantiles(df, "v", rules, ["g"]).collect()} == want
    assert {r["g"]: (r["l"], r["u"], r["r"]) for r in quantiles_of_few(df, "v", rules, ["g"]).collect()} == want
    assert quantiles(df.limit(0), "v", rules, []).count() == 0


def test_a_million_values_in_one_bucket(spark):
    df = spark.range(1_000_000).select((F.lit(1e9) + F.xxhash64("id") % 1_000_003 / 2**24).alias("v"))
    got = quantiles(df, "v", {"m": (0.5, "lower"), "p": (0.999, "rank")}, [], stored=True).first()
    want = np.sort(df.toPandas()["v"].to_numpy())
    assert (got["m"], got["p"]) == (want[499_999], want[998_999])


def test_rounds_move_counts_not_values(spark):
    values = spark.range(1000).select(F.rand(1).alias("_v"), (F.col("id") % 3).alias("g"))
    plan = counts(values, ["g"], bucket_of(F.col("_v")))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    # one shuffle, by group and bucket, of sums made before it
    assert len(moved) == 1 and "hashpartitioning(g#" in moved[0] and "_v#" not in moved[0] and "partial_count" in plan


def test_average_chained_over_chunks(spark):
    rng = random.Random(9)
    values = [rng.uniform(-1, 1) for _ in range(900)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, o bigint, v double")
    got = {r["o"]: r["ema"] for r in sessions.ema(df, ["k"], "o", "v", 0.2, 3, span=16).collect()}
    v, want = None, {}
    for i in range(0, 900, 3):
        v = values[i] if v is None else v + 0.2 * (values[i] - v)
        want[i] = v
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)


def test_average_at_any_share(spark):
    rng = random.Random(10)
    values = [rng.uniform(-1, 1) for _ in range(3000)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(2, 0, 5.0)], "k int, o bigint, v double")
    for share in (1.0, 0.5, 0.001, 0.0):
        got = {(r["k"], r["o"]): r["ema"] for r in sessions.ema(df, ["k"], "o", "v", share, span=64).collect()}
        v = values[0]
        for i, r in enumerate(values):
            v = v + share * (r - v)
            assert math.isclose(got[1, i], v, abs_tol=1e-12)
        assert len(got) == 3001 and got[2, 0] == 5.0


def test_average_of_a_long_key(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.sin(F.col("id").cast("double")).alias("v"))
    got = sessions.ema(df, ["k"], "o", "v", 0.01).orderBy("o").toPandas()["ema"].to_numpy()
    v = 0.0
    for i in range(n):
        v += (1.0 if i == 0 else 0.01) * (math.sin(i) - v)
        assert abs(got[i] - v) < 1e-9


def test_draws_agree_in_sql_and_in_tasks(spark):
    got = [r[0] for r in spark.range(500).select(picks.draw(F.col("id"))).collect()]
    assert got == list(picks.draws(500))


def test_samples_are_distinct():
    rows = picks.sample_rows(7, picks.draws(picks.ITERATIONS * picks.GUARD))
    assert len(rows) == picks.ITERATIONS * 4
    assert all(len({p for i, _, p in rows if i == it}) == 4 for it in range(picks.ITERATIONS))
