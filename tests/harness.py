"""Runs registered queries against their DuckDB SQL, the way the gate does."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

REPO = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(REPO))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_spark(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tonewheel")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.lower()
    if "int" in t or t in ("long", "short"):
        return "int"
    if t in ("double", "float"):
        return "double"
    if t in ("varchar", "string"):
        return "string"
    return t


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return True, f"{name:28} rows-only n={len(got)} {took:.1f}s"
    t0 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    dtook = time.time() - t0
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    stypes = {c: kind(t) for c, t in df.dtypes}
    if sorted(cols) != sorted(df.columns):
        return False, f"{name:28} COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    note = "" if types == stypes else f" TYPES {[(c, stypes[c], types[c]) for c in types if types[c] != stypes[c]]}"
    if a == b:
        return not note, f"{name:28} ok n={len(a)} {took:.1f}s duck {dtook:.1f}s{note}"
    sa, sb = set(a), set(b)
    return False, (
        f"{name:28} MISMATCH n={len(a)} vs {len(b)} {took:.1f}s{note}\n   cols {sorted(cols)}\n   spark-only "
        f"({len(sa - sb)}) {sorted(sa - sb)[:3]}\n   duck-only ({len(sb - sa)}) {sorted(sb - sa)[:3]}"
    )


def main(argv):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    wanted = []
    for arg in argv:
        if arg.startswith("sf"):
            sf_dir = f"/root/testdata/{arg}"
        else:
            wanted.append(arg)
    spark, con = make_spark(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, text = False, f"{name:28} ERROR {str(e)[:900]}"
        if not ok:
            bad.append(name)
        print(text, flush=True)
    print("BAD:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
