"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

QUERIES = (
    "f3_group_scores", "f5_score_by_view", "d1_peaks", "g10_note_intervals", "g11_glow_at",
    "f18_steadiness", "e8_vote", "g1_track", "b10_label_points",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tonewheel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tonewheel.plans.catalog import QUERIES as registered

    def once(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took = {}
    for name in QUERIES:
        warm = once(name)
        took[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
        print(f"{name}: first {warm:.2f} s, then {took[name]:.2f} s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline queries, median wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()
