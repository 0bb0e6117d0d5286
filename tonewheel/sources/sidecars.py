"""Label files: scan, validate, explode, corrections, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.functions.geometry import col

_POINT = "STRUCT<x:DOUBLE,y:DOUBLE>"
SIDECAR_SCHEMA = (
    "kind STRING, imageWidth INT, imageHeight INT, corners ARRAY<" + _POINT + ">, cornerVisible ARRAY<BOOLEAN>, "
    "keys ARRAY<STRUCT<pitch:INT,black:BOOLEAN,top:ARRAY<" + _POINT + ">,front:ARRAY<" + _POINT + ">>>, "
    "ignoreMask STRING, sequence STRING, frameIndex INT, piano BOOLEAN, "
    "pose STRUCT<elevation:DOUBLE,azimuth:DOUBLE,distance:DOUBLE,rollDeg:DOUBLE,fovDeg:DOUBLE>, "
    "board STRUCT<keys:INT,whiteKeys:INT,lowestPitch:INT,lowestNote:STRING>, `case` BOOLEAN, caseColor STRING"
)
# The corrected-label kinds and their channels, corners taking 0 to 3.
FIXED_KINDS = {
    "corners": 0, "gaps": 4, "blackLow": 5, "blackHigh": 6, "blackTopLow": 7, "blackTopHigh": 8,
    "backGaps": 9, "blackBackLow": 10, "blackBackHigh": 11,
}
BACK_FILL = {"backGaps": "gaps", "blackBackLow": "blackLow", "blackBackHigh": "blackHigh"}
FIXED_SCHEMA = "width INT, height INT, whiteKeys INT, phase STRING, blackDepth DOUBLE, " + ", ".join(
    f"{k} ARRAY<ARRAY<DOUBLE>>" for k in FIXED_KINDS
)


def stem(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)\.[^./]*$", 1)


def folder(path) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def pair_with_images(sidecars: DataFrame, images: DataFrame) -> DataFrame:
    """A1: sidecars whose image of the same stem lies in the same directory."""
    pictured = images.where(F.lower("path").endswith(".png")).select(folder("path").alias("_folder"), stem("path").alias("stem"))
    return sidecars.withColumns({"_folder": folder("path"), "stem": stem("path")}).join(pictured, ["_folder", "stem"], "left_semi").drop("_folder")


def existing(spark: SparkSession, directories: str | list[str]) -> list[str]:
    """Those of the directories that the cluster's file system has."""
    names = [directories] if isinstance(directories, str) else list(directories)
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(name) for name in names]
    return [name for name, path in zip(names, paths) if path.getFileSystem(conf).exists(path)]


def read_texts(spark: SparkSession, directories: str | list[str]) -> DataFrame:
    found = existing(spark, directories)
    if not found:
        return spark.createDataFrame([], "path string, text string")
    return (
        spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(found)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def read_sidecars(spark: SparkSession, directories: str | list[str]) -> DataFrame:
    """A1: the sidecars of one or more directories as (stem, path, text), in no order; an absent directory has none.

    Directories lie on any file system that Spark reads. Equal stems of different directories stay apart.
    """
    texts, found = read_texts(spark, directories), existing(spark, directories)
    if not found:
        return texts.withColumn("stem", F.lit("")).select("stem", "path", "text")
    # only the names of the images are read
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(found).select("path")
    return pair_with_images(texts, images).select("stem", "path", "text")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is_int(v: Column) -> Column:
    # a JSON true counts as an integer in the label format
    return _kind(v).isin("BIGINT", "BOOLEAN")


def _is_number(v: Column) -> Column:
    return _kind(v).isin("BIGINT", "BOOLEAN", "DOUBLE", "FLOAT") | _kind(v).startswith("DECIMAL")


def _absent(v: Column) -> Column:
    return _kind(v) == "VOID"


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), 0)


def _face_reason(face: Column, what: str) -> Column:
    items = _items(face)

    def corner(c, i):
        label = F.concat(F.lit(f"{what} corner "), i.cast("string"))
        return F.when(~_kind(c).startswith("OBJECT"), F.concat(label, F.lit(" is not an object"))).when(
            ~_is_number(_field(c, "x")) | ~_is_number(_field(c, "y")), F.concat(label, F.lit(" has invalid coordinates"))
        )

    four = F.coalesce(F.size(items) == 4, F.lit(False)) & _kind(face).startswith("ARRAY")
    return F.when(~four, f"{what} must list exactly 4 corners").otherwise(_first(F.transform(items, corner)))


def _key_reason(key: Column) -> Column:
    front = _field(key, "front")
    return (
        F.when(~_kind(key).startswith("OBJECT"), "key entry must be an object")
        .when(
            ~_is_int(_field(key, "pitch")) | (_kind(_field(key, "black")) != "BOOLEAN"),
            "key entry has invalid pitch or black flag",
        )
        .otherwise(
            F.coalesce(
                _face_reason(_field(key, "top"), "key top face"),
                F.when(~_absent(front), _face_reason(front, "key front face")),
            )
        )
    )


def with_reason(df: DataFrame, text: str = "text") -> DataFrame:
    """A2: the first rule a sidecar breaks, NULL when it is well formed."""
    parsed = df.withColumn("_v", F.try_parse_json(text))
    v = F.col("_v")
    keys, corners = _field(v, "keys"), _field(v, "corners")
    visible = _items(_field(v, "cornerVisible"))
    flags = (F.size(visible) == 4) & F.forall(visible, lambda f: _kind(f) == "BOOLEAN")

    def wrong_unless(name, test):
        return ~_absent(_field(v, name)) & ~F.coalesce(test, F.lit(False))

    reason = (
        F.when(v.isNull(), "not valid json")
        .when(~_kind(v).startswith("OBJECT"), "not a json object")
        .when(~_is_int(_field(v, "imageWidth")) | ~_is_int(_field(v, "imageHeight")), "invalid image dimensions")
        .when(~_kind(keys).startswith("ARRAY"), "must list keys")
        .when(_absent(corners) & (F.size(_items(keys)) > 0), "has keys but no corners")
        .when(wrong_unless("ignoreMask", _kind(_field(v, "ignoreMask")) == "STRING"), "ignoreMask must name a file")
        .when(wrong_unless("sequence", _kind(_field(v, "sequence")) == "STRING"), "sequence must be a string")
        .when(wrong_unless("frameIndex", _is_int(_field(v, "frameIndex"))), "frameIndex must be an int")
        .when(wrong_unless("cornerVisible", flags), "cornerVisible must list 4 booleans")
        .otherwise(
            F.coalesce(
                F.when(~_absent(corners), _face_reason(corners, "keybed quad")),
                _first(F.transform(_items(keys), _key_reason)),
            )
        )
    )
    return parsed.withColumn("reason", reason).drop("_v")


def validate(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A2: (well formed, rejected with the reason)."""
    checked = with_reason(df, text)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """Well-formed sidecar texts as typed columns."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.from_json(text, SIDECAR_SCHEMA).alias("_s")).select(*keep, "_s.*")


def scaled(face, width, height) -> Column:
    return F.transform(
        col(face), lambda p: F.struct((p["x"] * col(width)).alias("x"), (p["y"] * col(height)).alias("y"))
    )


def to_pixels(frames: DataFrame) -> DataFrame:
    """A3: corners and key faces from frame fractions to frame pixels."""
    def key(k):
        return F.struct(
            k["pitch"].alias("pitch"), k["black"].alias("black"),
            scaled(k["top"], "imageWidth", "imageHeight").alias("top"),
            scaled(k["front"], "imageWidth", "imageHeight").alias("front"),
        )

    return frames.withColumn("corners", scaled("corners", "imageWidth", "imageHeight")).withColumn(
        "keys", F.transform("keys", key)
    )


def explode_keys(frames: DataFrame) -> DataFrame:
    """A4: one row per key."""
    return frames.select("frame_id", F.explode("keys").alias("k")).select("frame_id", "k.*")


def key_corners(keys: DataFrame) -> DataFrame:
    """A4: one row per key, face and corner."""
    faces = F.array(
        F.struct(F.lit("top").alias("face"), F.col("top").alias("points")),
        F.struct(F.lit("front").alias("face"), F.col("front").alias("points")),
    )
    faced = keys.select("frame_id", "pitch", "black", F.explode(faces).alias("f"))
    return faced.select(
        "frame_id", "pitch", "black", "f.face", F.posexplode("f.points").alias("corner", "p")
    ).select("frame_id", "pitch", "black", "face", "corner", F.col("p.x").alias("x_px"), F.col("p.y").alias("y_px"))


def frame_flags(frames: DataFrame) -> DataFrame:
    """A5: whether a frame is real, and whether it is a negative."""
    return frames.withColumn("is_real", F.coalesce(F.col("kind") == "real-keys", F.lit(False))).withColumn(
        "is_negative", F.col("corners").isNull() & (F.size("keys") == 0)
    )


def parse_fixed(df: DataFrame, text: str = "text") -> DataFrame:
    """Corrected labels with the rear kinds older files lack filled in as hidden."""
    keep = [c for c in df.columns if c != text]
    raw = df.select(*keep, F.from_json(text, FIXED_SCHEMA).alias("s")).select(*keep, "s.*")
    raw = raw.withColumn("lacks_rear", F.col("backGaps").isNull())
    hidden = F.lit(None).cast("array<double>")
    for kind, like in BACK_FILL.items():
        raw = raw.withColumn(
            kind, F.coalesce(kind, F.transform(F.col(like), lambda _: hidden))
        )
    return raw


def fixed_points(fixed: DataFrame) -> DataFrame:
    """One row per visible corrected point; `idx` counts hidden ones too, from 0."""
    kinds = F.array(
        *[
            F.struct(F.lit(c).alias("channel"), F.lit(k).alias("kind"), F.col(k).alias("points"))
            for k, c in FIXED_KINDS.items()
        ]
    )
    rows = fixed.select("frame_id", "lacks_rear", F.explode(kinds).alias("k")).select(
        "frame_id", "lacks_rear", "k.channel", F.posexplode("k.points").alias("idx", "p")
    ).where(F.col("p").isNotNull())
    corner = F.col("channel") == 0
    return rows.select(
        "frame_id",
        F.when(corner, F.col("idx")).otherwise(F.col("channel")).alias("channel"),
        F.when(corner, F.lit(0)).otherwise(F.col("idx")).alias("idx"),
        F.get("p", 0).alias("x_px"), F.get("p", 1).alias("y_px"), "lacks_rear",
    )


def read_fixed_labels(spark: SparkSession, directory: str) -> DataFrame:
    return parse_fixed(read_texts(spark, directory).withColumn("frame_id", stem("path")).drop("path"))


def export_labels(points: DataFrame, frames: DataFrame) -> DataFrame:
    """One JSON document per frame, low to high, a hidden point as null.

    Copies of a point collapse first, so a document's arrays are bounded by the instrument.
    """
    single = points.groupBy("frame_id", "channel", "idx").agg(F.min(F.struct("x_px", "y_px")).alias("p"))
    listed = single.select("frame_id", "channel", "idx", "p.*").groupBy("frame_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("channel", "idx"), F.array("x_px", "y_px")))).alias("at")
    )
    n = F.col("white_keys")

    def run(channel, count, first=0):
        return F.transform(
            F.sequence(F.lit(first), first + count - 1),
            lambda i: F.element_at("at", F.struct(F.lit(channel).alias("channel"), i.alias("idx"))),
        )

    none = F.array().cast("array<array<double>>")

    def series(channel, count):
        return F.when(count > 0, run(channel, count)).otherwise(none)

    corners = F.array(
        *[F.element_at("at", F.struct(F.lit(c).alias("channel"), F.lit(0).alias("idx"))) for c in range(4)]
    )
    doc = F.struct(
        F.col("width"), F.col("height"), n.alias("whiteKeys"), corners.alias("corners"),
        series(4, n - 1).alias("gaps"), series(5, F.col("blacks")).alias("blackLow"), series(6, F.col("blacks")).alias("blackHigh"),
    )
    return frames.join(listed, "frame_id").select(
        "frame_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json")
    )
