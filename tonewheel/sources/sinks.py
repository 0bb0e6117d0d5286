"""Published tables, score documents and key lines (H4-H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = "__pycache__"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish(
    spark: SparkSession, tables: dict[str, DataFrame | None], root: str, name: str, version: str, required: tuple[str, ...] = ()
) -> str:
    """H4: writes the tables under `root/name-version` and returns that URI.

    A missing required table and a version already taken are errors; optional tables may be None;
    rows whose `path` lies in a cache folder are left out.
    """
    for part in required:
        if tables.get(part) is None:
            raise FileNotFoundError(f"missing {part} table")
    uri = f"{root.rstrip('/')}/{name}-{version}"
    if _exists(spark, uri):
        raise FileExistsError(f"{uri} already has a bundle, pick a new version")
    for part, df in tables.items():
        if df is None:
            continue
        if "path" in df.columns:
            df = df.where(~F.array_contains(F.split("path", "/"), SKIPPED))
        df.write.mode("errorifexists").parquet(f"{uri}/{part}")
    return uri


def read_published(spark: SparkSession, uri: str, parts: tuple[str, ...]) -> DataFrame:
    out = None
    for part in parts:
        df = spark.read.parquet(f"{uri}/{part}").withColumn("source", F.lit(part))
        out = df if out is None else out.unionByName(df)
    return out


def score_json(scores: DataFrame) -> DataFrame:
    """H5: one (entry, json) per model, decoder and view; the overall view adds nothing to the name.

    `scores` has model, decoder, view, frames, failure_rate, grp and the group's metrics. A document
    lists at most the six point groups.
    """
    metrics = [c for c in scores.columns if c not in ("model", "decoder", "view", "frames", "failure_rate", "grp")]
    view = F.when(F.col("view") != "all", F.col("view"))
    docs = scores.groupBy(F.concat_ws(" ", "model", "decoder", view).alias("entry"), "frames", "failure_rate").agg(
        F.map_from_entries(F.collect_list(F.struct("grp", F.struct(*metrics).alias("m")))).alias("groups")
    )
    return docs.select("entry", F.to_json(F.struct("frames", "failure_rate", "groups"), {"ignoreNullFields": "false"}).alias("json"))


def write_scores(scores: DataFrame, path: str) -> None:
    """H5: one line per entry. Spark's committer moves a task's file in place once it is whole, so a failed or repeated task leaves
    nothing behind; `path` must be new."""
    docs = score_json(scores)
    docs.select(F.concat(F.to_json(F.struct("entry")), F.lit("\t"), "json")).write.text(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The written (entry, json)."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.from_json(parts[0], "entry string")["entry"].alias("entry"), parts[1].alias("json"))


def keys_lines(frames: DataFrame) -> DataFrame:
    """H6: one JSON line per frame beside its clip."""
    fields = [c for c in frames.columns if c != "clip_id"]
    return frames.select("clip_id", "frame", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


def write_keys_jsonl(frames: DataFrame, path: str) -> None:
    """H6: a folder of line files per clip, frames in order within a file and from file to file. A long clip spreads over
    tasks; files are committed as those of `write_scores`."""
    lines = keys_lines(frames).repartitionByRange("clip_id", "frame").sortWithinPartitions("clip_id", "frame")
    lines.select("clip_id", "line").write.partitionBy("clip_id").text(path)


RECEIPTS = "run string, batch bigint"


def deliver(batches: DataFrame, send, receipts: str) -> int:
    """H7: hands each body to the caller's `send(key, body)` from the tasks; how many were sent.

    `receipts` is a Parquet folder of the (run, batch) already sent, which are left out; those sent now are added when their
    task ends well. A task that fails midway is run again with all of its bodies, so `key`, run and batch, lets the receiver drop
    what it has.
    """
    spark = batches.sparkSession
    spark.createDataFrame([], RECEIPTS).write.mode("append").parquet(receipts)
    done = spark.read.schema(RECEIPTS).parquet(receipts)
    before = done.count()

    def run(frames):
        for frame in frames:
            for run_, batch, body in zip(frame["run"], frame["batch"], frame["body"]):
                send(f"{run_}/{batch}", body)
            yield frame[["run", "batch"]]

    fresh = batches.select("run", F.col("batch").cast("bigint").alias("batch"), "body").join(done, ["run", "batch"], "left_anti")
    fresh.mapInPandas(run, RECEIPTS).write.mode("append").parquet(receipts)
    return spark.read.schema(RECEIPTS).parquet(receipts).count() - before
