"""Matching detections to labels and scoring them (section F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions import geometry as G
from tonewheel.functions.geometry import col, div, point
from tonewheel.functions.lineage import cut
from tonewheel.functions.quantiles import quantiles, quantiles_of_few
from tonewheel.operators import dims
from tonewheel.operators.detect import local_maxima, neighbours

# Fixed values of the scoring rules.
MATCH_KEYS = 0.5
PCK_KEYS = (0.1, 0.25)
KEY_WIDTH_MM, KEYBED_DEPTH_MM = 23.5, 150.0
TRUTH_LEAST = 0.8
SINGLE_PEAK_LEAST = 0.5
SHIFTS = (-2, -1, 0, 1, 2)

LABEL_KEY = ["frame_id", "channel", "idx"]


def match_nearest(
    labels: DataFrame, peaks: DataFrame, match_keys: float = MATCH_KEYS, cell_px: float = 16.0
) -> DataFrame:
    """each label with its distance, in key widths, to the nearest peak of its frame and channel.

    `labels` carries `key_px`. A label is matched within `match_keys`; otherwise its error is NULL.
    Only peaks inside the match radius can matter, so labels and peaks meet on square cells rather
    than all against all: a label visits the cells its radius touches. Peaks at the same place
    collapse before the join. Identical label rows count apart: they are folded to one with their
    number, which depends on no row order, and unfolded at the end.
    """
    def cell(c):
        return F.floor(col(c) / F.lit(cell_px)).cast("bigint")

    radius = F.col("key_px") * F.lit(match_keys)
    spots = peaks.select("frame_id", "channel", F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    spots = spots.withColumn("_cx", cell("px")).withColumn("_cy", cell("py"))

    def reach(c):
        return F.sequence(cell(F.col(c) - radius), cell(F.col(c) + radius))

    folded = labels.groupBy(*labels.columns).agg(F.count(F.lit(1)).cast("int").alias("_same"))
    seekers = folded.withColumn("_cx", F.explode_outer(reach("x"))).withColumn("_cy", F.explode_outer(reach("y")))
    near = seekers.join(spots, ["frame_id", "channel", "_cx", "_cy"], "left")
    keys = div(G.length(F.col("px") - F.col("x"), F.col("py") - F.col("y")), F.col("key_px"))
    best = near.groupBy(*labels.columns, "_same").agg(F.min(F.when(keys <= match_keys, keys)).alias("error_keys"))
    best = best.withColumn("_same", F.explode(F.sequence(F.lit(1), F.col("_same")))).drop("_same")
    return best.withColumn("matched", F.col("error_keys").isNotNull())


def front_key_width(corners, gaps) -> Column:
    """the front edge over the key count."""
    p = G.corners_of(corners)
    return div(G.dist(p[3], p[2]), (col(gaps) + 1).cast("double"))


def group_scores(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """labels, recall, median and mean matched error and pck per point group.

    Errors are NULL, not NaN, where nothing matched.
    """
    keys = [*(by or []), "grp"]
    # the matches are read again by every round of the medians
    grouped = cut(matches.select(*(by or []), dims.group_of("channel").alias("grp"), "error_keys"))
    e = F.col("error_keys")
    n, m = F.count(F.lit(1)), F.count(e)
    sums = grouped.groupBy(*keys).agg(
        n.alias("labels"),
        div(m.cast("double"), n.cast("double")).alias("recall"),
        F.avg(e).alias("mean_keys"),
        *[
            F.coalesce(div(F.count(F.when(e <= k, 1)).cast("double"), m.cast("double")), F.lit(0.0)).alias(
                f"pck_{str(k).replace('.', '_')}"
            )
            for k in PCK_KEYS
        ],
    )
    medians = quantiles(grouped, "error_keys", {"median_keys": (0.5, "interp")}, keys, stored=True)
    return sums.join(medians, keys, "left")


def scorable_frames(labels: DataFrame) -> DataFrame:
    """Frames whose four corners are all labelled; the others have no crop and are left out."""
    seen = labels.where(F.col("channel") <= 3).groupBy("frame_id").agg(
        *[F.bool_or(F.col("channel") == c).alias(f"c{c}") for c in range(4)]
    )
    return seen.where("c0 and c1 and c2 and c3").select("frame_id")


def frame_failures(matches: DataFrame, frames: DataFrame) -> DataFrame:
    """F4, per frame: failed when a visible corner label went unmatched."""
    missed = matches.where((F.col("channel") <= 3) & ~F.col("matched")).groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("missed")
    )
    return frames.join(missed, "frame_id", "left").select(
        *frames.columns, F.col("missed").isNotNull().alias("failed")
    )


def failure_rate(failures: DataFrame, by: list[str] | None = None) -> DataFrame:
    """frames and the share of them that failed."""
    return failures.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.col("failed").cast("double")).alias("failure_rate")
    )


def camera_elevation(corners, white_keys) -> Column:
    """Degrees over the keybed, from how much its depth is foreshortened."""
    p = G.corners_of(corners)
    width = (G.dist(p[0], p[1]) + G.dist(p[3], p[2])) / F.lit(2.0)
    depth = (G.dist(p[0], p[3]) + G.dist(p[1], p[2])) / F.lit(2.0)
    true_ratio = F.lit(KEYBED_DEPTH_MM) / (F.lit(KEY_WIDTH_MM) * col(white_keys))
    share = div(div(depth, width), true_ratio)
    return F.degrees(F.asin(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))


def elevation_bucket(degrees) -> Column:
    """An edge belongs to the bucket below it."""
    d = col(degrees)
    return F.when(d <= 30.0, "low").when(d <= 60.0, "mid").otherwise("high")


def with_views(df: DataFrame, white_keys: str = "white_keys", elevation: str = "elevation_deg") -> DataFrame:
    """one row per view a frame belongs to: all, its board size, its elevation bucket."""
    views = F.array(
        F.lit("all"),
        F.concat(F.col(white_keys).cast("string"), F.lit(" white keys")),
        F.concat(F.lit("elevation "), elevation_bucket(elevation)),
    )
    return df.withColumn("view", F.explode(views))


def score_by_view(matches: DataFrame) -> DataFrame:
    """group scores per view from one pass over the matches."""
    return group_scores(with_views(matches), ["view"])


def score_cells(cells: DataFrame, threshold: float = 0.3, keys: tuple = ("frame_id", "channel")) -> DataFrame:
    """per frame precision, recall and error of predicted peaks against target peaks.

    `cells` has predicted, target and weight per grid cell. The match radius of 1.5 cells is the
    eight neighbours and the cell itself, so the nearest guess is found by equality on those.
    """
    keys = list(keys)
    kept = cells.where(F.col("weight") > 0).select(*keys, "i", "j")
    guess = local_maxima(cells.select(*keys, "i", "j", F.col("predicted").alias("value")), threshold, keys)
    truth = local_maxima(
        cells.where(F.col("target") >= TRUTH_LEAST).select(*keys, "i", "j", F.col("target").alias("value")),
        threshold,
        keys,
    )
    guess = guess.join(kept, [*keys, "i", "j"], "left_semi").select(*keys, "i", "j")
    truth = truth.join(kept, [*keys, "i", "j"], "left_semi").select(*keys, "i", "j")
    around = truth.select(
        *keys, F.col("i").alias("ti"), F.col("j").alias("tj"), F.explode(neighbours()).alias("_d")
    ).select(
        *keys, "ti", "tj", (F.col("ti") + F.col("_d.di")).alias("i"), (F.col("tj") + F.col("_d.dj")).alias("j"),
        F.sqrt((F.col("_d.di") * F.col("_d.di") + F.col("_d.dj") * F.col("_d.dj")).cast("double")).alias("away"),
    )
    hits = (
        around.join(guess, [*keys, "i", "j"])
        .groupBy(*keys, "ti", "tj")
        .agg((F.min("away") * 2.0).alias("error_px"))
    )

    def tally(df, n, h, e):
        return df.select("frame_id", n.alias("predictions"), h.alias("truths"), e.alias("error_px"))

    one, zero, none = F.lit(1), F.lit(0), F.lit(None).cast("double")
    rows = (
        tally(guess, one, zero, none)
        .unionByName(tally(truth, zero, one, none))
        .unionByName(tally(hits, zero, zero, F.col("error_px")))
        .unionByName(tally(cells.select("frame_id").distinct(), zero, zero, none))
    )
    found = F.count("error_px").cast("double")
    predictions, truths = F.sum("predictions"), F.sum("truths")
    return rows.groupBy("frame_id").agg(
        predictions.alias("predictions"),
        truths.alias("truths"),
        F.coalesce(div(found, predictions.cast("double")), F.lit(1.0)).alias("precision"),
        F.coalesce(div(found, truths.cast("double")), F.lit(1.0)).alias("recall"),
        F.coalesce(F.avg("error_px"), F.lit(0.0)).alias("error_px"),
    )


def evaluate_frames(frame_scores: DataFrame, presence: DataFrame) -> DataFrame:
    """plain means over frames, with the share of frames whose presence was called right."""
    right = (F.col("said") >= 0.5) == (F.col("presence_target") >= 0.5)
    return frame_scores.join(presence, "frame_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("error_px").alias("error_px"),
        F.avg(right.cast("double")).alias("presence_accuracy"),
    )


def heat_loss(cells: DataFrame, single_peak: bool = False) -> DataFrame:
    """F8: penalty-reduced focal loss per batch: a sum per channel over its weighted positives, then
    the mean over channels. `cells` has batch_id, frame_id, channel, i, j, logit, target, weight."""
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), div(F.lit(1.0), F.lit(1.0) + F.exp(-F.col("logit")))))
    t, w = F.col("target"), F.col("weight")
    if single_peak:
        keys = ["batch_id", "frame_id", "channel"]
        own = local_maxima(cells.select(*keys, "i", "j", t.alias("value")), SINGLE_PEAK_LEAST, keys)
        cells = cells.join(
            own.select(*keys, "i", "j", F.lit(True).alias("_own")), [*keys, "i", "j"], "left"
        )
        peak = F.col("_own").isNotNull()
    else:
        peak = t >= TRUTH_LEAST
    positive = -F.pow(F.lit(1.0) - p, F.lit(2.0)) * F.log(p)
    negative = -F.pow(F.lit(1.0) - t, F.lit(4.0)) * F.pow(p, F.lit(2.0)) * F.log(F.lit(1.0) - p)
    per_channel = cells.groupBy("batch_id", "channel").agg(
        F.sum(F.when(peak, positive).otherwise(negative) * w).alias("loss"),
        F.greatest(F.sum(F.when(peak, w).otherwise(0.0)), F.lit(1.0)).alias("positives"),
    )
    return per_channel.groupBy("batch_id").agg(F.avg(div("loss", "positives")).alias("heat_loss"))


def offset_loss(cells: DataFrame) -> DataFrame:
    """F8: weighted mean absolute offset error, x and y counted alike."""
    away = F.abs(F.col("dx") - F.col("target_dx")) + F.abs(F.col("dy") - F.col("target_dy"))
    return cells.groupBy("batch_id").agg(
        div(F.sum(away * F.col("weight")), F.greatest(F.sum(F.col("weight") * 2.0), F.lit(1.0))).alias("offset_loss")
    )


def fit_errors(fits: DataFrame, labels: DataFrame) -> DataFrame:
    """F9's distances: template points through each frame's fit against labels, in key widths.

    `fits` has frame_id, white_keys, phase, homography; `labels` has frame_id, channel, idx (from 1),
    x_px, y_px plus the frame's width, height, label_keys and key_px.
    """
    template = dims.template_points(fits).where(F.col("channel").isin(2, 3, 4, 5, 6))
    px, py = G.project("homography", "x", "y")
    placed = template.select(
        "frame_id", "white_keys", "channel", "ord", px.alias("fx"), py.alias("fy"),
        F.explode(
            F.when(F.col("channel") == 4, F.array(*[F.lit(s) for s in SHIFTS])).otherwise(F.array(F.lit(0)))
        ).alias("shift"),
    ).withColumn("idx", F.col("ord") + F.col("shift"))
    met = placed.join(labels, ["frame_id", "channel", "idx"])
    away = G.length(F.col("fx") * F.col("width") - F.col("x_px"), F.col("fy") * F.col("height") - F.col("y_px"))
    return met.select("frame_id", "channel", "shift", div(away, F.col("key_px")).alias("error_keys"))


def check_fit(fits: DataFrame, labels: DataFrame, frames: DataFrame, blacks: DataFrame) -> DataFrame:
    """the right board, the numbering shift with the least gap error, and median errors.

    `frames` lists (frame_id, label_keys); `blacks` (frame_id, label_blacks) counts labelled blacks.
    Black errors count only where fit and labels hold equally many.
    """
    part = F.when(F.col("channel") == 4, "gap").when(F.col("channel") >= 5, "black").otherwise("corner")
    errors = fit_errors(fits, labels).withColumn("part", part)
    medians = quantiles_of_few(errors, "error_keys", {"median": (0.5, "upper")}, ["frame_id", "part", "shift"])
    m, gap = F.col("median"), F.col("part") == "gap"
    per_frame = medians.groupBy("frame_id").agg(
        F.min(F.when(gap, F.struct(m, F.col("shift"))))["shift"].alias("best_shift"),
        F.max(F.when(gap & (F.col("shift") == 0), m)).alias("gap_median"),
        F.max(F.when(F.col("part") == "black", m)).alias("black_median"),
        F.max(F.when(F.col("part") == "corner", m)).alias("corner_keys"),
    )
    fit_blacks = dims.board_keys(fits.select("frame_id", "white_keys", "phase")).groupBy("frame_id").agg(
        (F.count(F.when(F.col("black"), 1)) * 2).alias("fit_blacks")
    )
    joined = (
        frames.join(fits.select("frame_id", "white_keys", "phase"), "frame_id", "left")
        .join(per_frame, "frame_id", "left")
        .join(fit_blacks, "frame_id", "left")
        .join(blacks, "frame_id", "left")
    )
    right = F.coalesce(F.col("white_keys") == F.col("label_keys"), F.lit(False))
    same = F.col("fit_blacks") == F.coalesce(F.col("label_blacks"), F.lit(0))
    return joined.select(
        "frame_id",
        F.col("white_keys").isNotNull().alias("acquired"),
        F.concat(F.col("white_keys").cast("string"), "phase").alias("board"),
        right.alias("right_board"),
        F.when(right, F.coalesce("best_shift", F.lit(SHIFTS[0]))).alias("shift"),
        F.when(right, F.col("gap_median")).alias("gap_keys"),
        F.when(same, F.col("black_median")).alias("black_keys"),
        F.col("corner_keys"),
    )


def rounded(x: Column, places: int) -> Column:
    scale = F.lit(10.0**places)
    return G.js_round(x * scale) / scale


def summarise_fits(checks: DataFrame) -> DataFrame:
    """shares of frames, and medians over the frames numbered right."""
    def share(c):
        return F.coalesce(rounded(F.avg(c.cast("double")), 2), F.lit(0.0))

    checks = cut(checks)
    numbered = F.coalesce(F.col("shift") == 0, F.lit(False))
    shares = checks.agg(
        F.count(F.lit(1)).alias("frames"),
        share(F.col("acquired")).alias("acquired"),
        share(F.col("right_board")).alias("right_board"),
        share(numbered).alias("right_numbering"),
    )
    values = checks.where(numbered).select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in ("gap_keys", "black_keys", "corner_keys")])
        ).alias("e")
    ).select("e.name", "e.v")
    medians = quantiles(values, "v", {"median": (0.5, "upper")}, ["name"]).agg(
        *[
            rounded(F.max(F.when(F.col("name") == n, F.col("median"))), 3).alias(n)
            for n in ("gap_keys", "black_keys", "corner_keys")
        ]
    )
    # both sides are single aggregate rows
    return shares.join(F.broadcast(medians), F.lit(True), "left")


def acquisition_audit(frames: DataFrame, restart_every: int) -> DataFrame:
    """per video and over all, with the tracker restarted every so many frames.

    `frames` has video, frame_index, fitted, mirrored. A restart forgets the frame before, so the
    previous frame is only looked for inside its segment, which bounds every window.
    """
    segment = F.floor(F.col("frame_index") / F.lit(restart_every))
    w = Window.partitionBy("video", "_segment").orderBy("frame_index")
    before = F.coalesce(F.lag("fitted").over(w), F.lit(False))
    rows = frames.withColumn("_segment", segment).withColumn("_acquired", F.col("fitted") & ~before)

    def n(c):
        return F.count(F.when(c, 1))

    fitted, mirrored, acquired = F.col("fitted"), F.col("mirrored"), F.col("_acquired")
    per_video = rows.groupBy("video").agg(
        F.count(F.lit(1)).alias("frames"),
        n(fitted).alias("fitted"),
        n(acquired).alias("acquisitions"),
        n(acquired & mirrored).alias("backwards"),
        n(fitted & mirrored).alias("mirrored"),
    )
    return per_video.rollup("video").agg(
        *[F.sum(c).alias(c) for c in ("frames", "fitted", "acquisitions", "backwards", "mirrored")]
    )


def back_edge_distances(backs: DataFrame, fits: DataFrame) -> DataFrame:
    """F12's distances: labelled key backs against the fitted back edge, in pixels, positive where
    the edge sits in front of them.

    `backs` has frame_id, x, y in frame fractions; `fits` has homography, white_keys, lens_k,
    lens_aspect, width, height. Points close to the picture's border are left out.
    """
    inside = (F.col("x") >= 0.02) & (F.col("x") < 0.98) & (F.col("y") >= 0.02) & (F.col("y") < 0.98)
    met = backs.where(inside).join(fits, "frame_id")
    seen = point("x", "y")
    on = met.withColumn("_on", G.back("homography", G.straightened(seen, "lens_k", "lens_aspect"))).where(
        (F.col("_on.x") >= 0) & (F.col("_on.x") <= F.col("white_keys")) & (F.abs("_on.y") <= 0.5)
    )
    edge = G.bent(G.onto("homography", point(F.col("_on.x"), F.lit(0.0))), "lens_k", "lens_aspect")
    on = on.withColumn("_edge", edge)
    apart = G.length(
        (F.col("_edge.x") - F.col("x")) * F.col("width"), (F.col("_edge.y") - F.col("y")) * F.col("height")
    )
    side = F.when(F.col("_on.y") >= 0, -1.0).otherwise(1.0)
    return on.select(*backs.columns, (side * apart).alias("ahead_px"))


def back_edge_report(distances: DataFrame) -> DataFrame:
    """per case colour and over all: count, signed median, absolute median and p90."""
    named = distances.select(
        F.explode(F.array(F.lit("all"), F.coalesce("case_color", F.lit("unnamed")))).alias("case_color"), "ahead_px"
    )
    # the rounds of the quantiles read the distances again and again
    named = cut(named)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in (("ahead", F.col("ahead_px")), ("off", F.abs("ahead_px")))])
    values = named.select("case_color", F.explode(kinds).alias("k")).select("case_color", "k.kind", "k.v")
    q = quantiles(values, "v", {"median": (0.5, "trunc"), "p90": (0.9, "trunc")}, ["case_color", "kind"])

    def pick(kind, what):
        return F.max(F.when(F.col("kind") == kind, F.col(what)))

    report = q.groupBy("case_color").agg(
        pick("ahead", "median").alias("ahead_median"), pick("off", "median").alias("off_median"), pick("off", "p90").alias("off_p90")
    )
    counts = named.groupBy("case_color").agg(F.count("ahead_px").alias("backs"))
    return counts.join(report, "case_color", "left")


def end_for_end(frames: DataFrame) -> DataFrame:
    """frames fitted and those whose fit and label quads differ in handedness."""
    other = G.is_mirrored("label_quad") != G.is_mirrored("fit_quad")
    return frames.agg(
        F.count("fit_quad").alias("fitted"),
        F.count(F.when(F.coalesce(other, F.lit(False)), 1)).alias("end_for_end"),
    )


def latency_summary(lines: DataFrame, by: list[str]) -> DataFrame:
    """median and p95 by nearest rank, and the tracked percentage."""
    sums = lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), (F.avg(F.col("tracked").cast("double")) * 100.0).alias("tracked_pct")
    )
    ranks = quantiles(lines, "process_ms", {"median_ms": (0.5, "rank"), "p95_ms": (0.95, "rank")}, by)
    return sums.join(ranks, by, "left")


def flatten_metrics(scores: DataFrame, value: str = "score", prefix=None) -> DataFrame:
    """every number in a nested score document as (path, value), the path joined with slashes.

    `value` is a VARIANT, nested as deep as it may be: each level's objects are stored before they are
    opened, until a level has none. Booleans, strings and nulls are not numbers.
    """
    keep = [c for c in scores.columns if c != value]
    start = F.lit("") if prefix is None else col(prefix)
    level = scores.select(*keep, start.alias("path"), F.col(value).alias("_v"))
    kind = F.schema_of_variant("_v")
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    out = None
    while True:
        numbers = level.where(number).select(*keep, "path", F.try_variant_get("_v", "$", "double").alias("value"))
        out = numbers if out is None else out.unionByName(numbers)
        objects = cut(level.where(kind.startswith("OBJECT")))
        if objects.isEmpty():
            return out
        level = objects.lateralJoin(
            objects.sparkSession.tvf.variant_explode(F.col("_v").outer())
        ).select(
            *keep,
            F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws("/", "path", "key")).alias("path"),
            F.col("value").alias("_v"),
        )


def model_metrics(entries: DataFrame, model: str, prefix: str) -> DataFrame:
    """one model's entries; the text after model and decoder names the view."""
    rest = F.expr(f"substring(entry, {len(model) + 1})")
    words = F.ltrim(rest)
    view = F.when(words.rlike(r"^\S+\s+\S"), F.regexp_extract(words, r"^\S+\s+(.*)$", 1)).otherwise("")
    path = F.concat_ws("/", *[F.when(p != "", p) for p in (F.lit(prefix), view)])
    kept = entries.where(F.col("entry").startswith(model)).withColumn("_path", path)
    return flatten_metrics(kept, "score", "_path").drop("_path")
