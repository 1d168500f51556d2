"""Vehicle counts from tracked detections: density, flow, dwell, fleet profiles.

Detections: video_id, track_id, frame, cls, cx, cy, sub (order inside a frame).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions.numbers import per, rounded
from soundfield.operators.quantiles import grouped_median, grouped_quantiles
from soundfield.operators.scans import keep_first, previous_value, with_scalars
from soundfield.operators.scenario import Scenario, with_scenarios
from soundfield.session import cut_lineage

FRAMES_PER_CHUNK = 1 << 16


def _order() -> list[Column]:
    return [F.col("frame"), F.col("sub"), F.col("cx"), F.col("cy")]


def track_summary(detections: DataFrame) -> DataFrame:
    """One row per (video, track, class): the pass over the detections that everything but crossings shares.

    Detections without a track keep a null track and count for density only.
    """
    return detections.groupBy("video_id", "track_id", "cls").agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.struct(*_order(), "cls")).alias("first_seen"),
        F.min("cx").alias("x_lo"), F.max("cx").alias("x_hi"), F.min("cy").alias("y_lo"), F.max("cy").alias("y_hi"),
    )


def track_classes(summary: DataFrame) -> DataFrame:
    """Modal class of each track; the class seen first wins a tie."""
    votes = summary.where("track_id is not null")
    return keep_first(votes, ["video_id", "track_id"], [F.desc("votes"), F.col("first_seen")]).select(
        "video_id", "track_id", F.col("cls").alias("track_cls"), "votes"
    )


def dominant_axis(summary: DataFrame, width: float, height: float) -> DataFrame:
    """x where the summed horizontal spans, in image widths, exceed the vertical ones in heights."""
    spans = summary.where("track_id is not null").groupBy("video_id", "track_id").agg(
        (F.max("x_hi") - F.min("x_lo")).alias("sx"), (F.max("y_hi") - F.min("y_lo")).alias("sy")
    )
    total = spans.groupBy("video_id").agg(F.sum("sx").alias("span_x"), F.sum("sy").alias("span_y"))
    return total.withColumn("axis", F.when(F.col("span_x") / width > F.col("span_y") / height, "x").otherwise("y"))


def crossings(
    detections: DataFrame, width: float, height: float, dead_band: float = C.DEAD_BAND, summary: DataFrame | None = None
) -> DataFrame:
    """Line crossings of each track: at most one per direction.

    Positions inside the dead band are left out; a crossing is a change of side
    between consecutive remaining positions.
    """
    summary = track_summary(detections) if summary is None else summary
    axes = dominant_axis(summary, width, height).select("video_id", "axis")
    placed = detections.where("track_id is not null").join(axes, "video_id")
    extent = F.when(F.col("axis") == "x", float(width)).otherwise(float(height))
    v = F.when(F.col("axis") == "x", F.col("cx")).otherwise(F.col("cy"))
    side = F.when(v > extent / 2 + dead_band * extent, 1).when(v < extent / 2 - dead_band * extent, -1)
    sided = placed.withColumn("side", side).where("side is not null")
    chunk = F.floor(F.col("frame") / FRAMES_PER_CHUNK).cast("bigint")
    moved = previous_value(sided, ["video_id", "track_id"], chunk, _order(), "side", "side_before")
    changes = moved.where("side_before is not null and side_before <> side")
    return changes.groupBy("video_id", "track_id").agg(
        F.least(F.sum((F.col("side") == 1).cast("int")), F.lit(1)).alias("forward"),
        F.least(F.sum((F.col("side") == -1).cast("int")), F.lit(1)).alias("backward"),
        F.count(F.lit(1)).alias("raw_changes"),
    ).withColumn("crossings", F.col("forward") + F.col("backward"))


def flow_per_class(
    detections: DataFrame, videos: DataFrame, width: float, height: float, summary: DataFrame | None = None
) -> DataFrame:
    """Crossings per minute by voted class for each video (long form)."""
    summary = track_summary(detections) if summary is None else summary
    counted = crossings(detections, width, height, summary=summary).join(track_classes(summary), ["video_id", "track_id"])
    per = counted.groupBy("video_id", F.col("track_cls").alias("cls")).agg(F.sum("crossings").alias("crossings"))
    return per.join(videos.where("duration_s > 0").select("video_id", "duration_s"), "video_id").withColumn(
        "flow_per_min", F.col("crossings") / (F.col("duration_s") / 60.0)
    )


def density_per_video(
    summary: DataFrame, videos: DataFrame, classes: Sequence[str] = C.VEHICLE_CLASSES, n_frames: str = "n_frames"
) -> DataFrame:
    """Mean objects per sampled frame, by class and in all; frames without objects count as zero."""
    seen = summary.where(F.col("cls").isin(*classes)).groupBy("video_id").agg(
        F.sum("votes").alias("n_all"), *[F.sum(F.when(F.col("cls") == c, F.col("votes")).otherwise(0)).alias(f"n_{c}") for c in classes]
    )
    joined = videos.where(F.col(n_frames) > 0).join(seen, "video_id", "left")
    mean = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0)) / F.col(n_frames)
    return joined.select(
        *videos.columns, *[mean(c).alias(f"{c}_mean") for c in classes], mean("all").alias("vehicles_mean")
    )


def dwell(summary: DataFrame, sample_fps: float = C.SAMPLE_FPS) -> DataFrame:
    """Tracks per video and their mean length in seconds."""
    lengths = summary.where("track_id is not null").groupBy("video_id", "track_id").agg(F.sum("votes").alias("len"))
    return lengths.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_tracks"), (F.avg("len") / sample_fps).alias("dwell_s")
    )


def video_counts(detections: DataFrame, videos: DataFrame, width: float, height: float, classes=C.VEHICLE_CLASSES) -> DataFrame:
    """The wide per-video table: density, flow, dwell, axis; two decimals, half-even."""
    motor = [c for c in classes if c in C.MOTOR_CLASSES]
    summary = cut_lineage(track_summary(detections))
    density = density_per_video(summary, videos, classes)
    flow = flow_per_class(detections, videos, width, height, summary).groupBy("video_id").pivot("cls", list(classes)).agg(
        F.sum("flow_per_min")
    )
    flow = flow.select("video_id", *[F.col(c).alias(f"{c}_flow") for c in classes])
    total = sum((F.coalesce(F.col(f"{c}_flow"), F.lit(0.0)) for c in motor), F.lit(0.0))
    out = (
        density.join(flow, "video_id", "left")
        .join(dwell(summary), "video_id", "left")
        .join(dominant_axis(summary, width, height).select("video_id", F.col("axis").alias("line_axis")), "video_id", "left")
        .withColumn("vehicles_flow", total)
        .withColumn("n_tracks", F.coalesce("n_tracks", F.lit(0)))
        .withColumn("dwell_s", rounded(F.coalesce("dwell_s", F.lit(0.0)), 2))
        .withColumn("line_axis", F.coalesce("line_axis", F.lit("y")))
    )
    for c in [*classes, "vehicles"]:
        out = out.withColumn(f"{c}_mean", rounded(f"{c}_mean", 2))
        out = out.withColumn(f"{c}_flow", rounded(F.coalesce(f"{c}_flow", F.lit(0.0)), 2))
    return out


def littles_law(counts: DataFrame) -> DataFrame:
    """Residence time implied by density and flow against the observed one."""
    ok = counts.where("vehicles_flow > 0 and vehicles_mean > 0")
    implied = F.col("vehicles_mean") / (F.col("vehicles_flow") / 60.0)
    ratio = implied / F.when(F.col("dwell_s") != 0, F.col("dwell_s"))
    rows = ok.select(
        F.explode(F.array(
            F.struct(F.lit("implied_s").alias("what"), implied.alias("v")),
            F.struct(F.lit("observed_s").alias("what"), F.col("dwell_s").cast("double").alias("v")),
            F.struct(F.lit("ratio").alias("what"), ratio.alias("v")),
        )).alias("e")
    ).select("e.what", "e.v")
    med = grouped_median(rows, ["what"], F.col("v"), "m")
    wide = med.groupBy().pivot("what", ["implied_s", "observed_s", "ratio"]).agg(F.max("m"))
    return wide.withColumn("consistent", (F.col("ratio") > 0.3) & (F.col("ratio") < 3))


def flow_dispersion(counts: DataFrame, at_least: int = 3, flow: str = "vehicles_flow") -> DataFrame:
    """Quartiles of the coefficient of variation of flow inside (site, hour) groups."""
    groups = counts.groupBy("site", "hour").agg(
        F.count(F.lit(1)).alias("n"), per(F.stddev_samp(flow), F.avg(flow)).alias("cv")
    ).where((F.col("n") >= at_least) & F.col("cv").isNotNull())
    q = grouped_quantiles(groups, [], F.col("cv"), {"cv_q1": 0.25, "cv_median": 0.5, "cv_q3": 0.75})
    n = groups.agg(F.count(F.lit(1)).alias("groups"))
    return with_scalars(n, q)


def flow_kpis(counts: DataFrame, flow: str = "vehicles_flow") -> DataFrame:
    head = counts.agg(F.count(flow).alias("n"), F.avg(flow).alias("mean_flow"), F.max(flow).alias("max_flow"))
    q = grouped_median(counts, [], F.col(flow), "median_flow")
    return with_scalars(head, q)


# ----------------------------------------------------------------------- fleet by hour


def fleet_observed(counts: DataFrame, classes: Sequence[str] = C.MOTOR_CLASSES) -> DataFrame:
    """Per (site, hour) with videos: their number, mean level, densities, flows and totals."""
    return counts.where("site is not null").groupBy("site", "hour").agg(
        F.count(F.lit(1)).alias("n_videos"), F.avg("matched_db").alias("mean_db"),
        *[F.avg(f"{c}_mean").alias(c) for c in classes],
        *[F.avg(f"{c}_flow").alias(f"{c}_fl") for c in classes],
    ).withColumn("total", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in classes), F.lit(0.0))).withColumn(
        "total_fl", sum((F.coalesce(F.col(f"{c}_fl"), F.lit(0.0)) for c in classes), F.lit(0.0))
    )


def fill_hours(observed: DataFrame, columns: Sequence[str], hours: tuple[int, int] = C.MAP_HOURS) -> DataFrame:
    """All hours of the window for every site; gaps linear inside, nearest value at the ends.

    Each column is filled on its own.  `measured` tells filled hours apart.  A
    site holds at most one row per hour, so its window stays tiny.
    """
    low, high = hours
    frame = observed.select("site").distinct().withColumn("hour", F.explode(F.sequence(F.lit(low), F.lit(high))))
    full = frame.join(observed, ["site", "hour"], "left").withColumn("measured", F.col("n_videos").isNotNull().cast("int"))
    back = Window.partitionBy("site").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("site").orderBy("hour").rowsBetween(0, Window.unboundedFollowing)
    filled = []
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("hour").alias("h"), F.col(c).alias("v")))
        p, q = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
        full = full.withColumn(f"__p_{c}", p).withColumn(f"__q_{c}", q)
        before, after = F.col(f"__p_{c}"), F.col(f"__q_{c}")
        gap = (after["h"] - before["h"]).cast("double")
        line = before["v"] + (after["v"] - before["v"]) * ((F.col("hour") - before["h"]) / F.when(gap > 0, gap))
        filled.append(F.coalesce(line, before["v"], after["v"]).alias(c))
    keep = [c for c in observed.columns if c not in ("site", "hour", "n_videos", *columns)]
    return full.select("site", "hour", "measured", F.coalesce("n_videos", F.lit(0)).alias("n_videos"), *keep, *filled)


def fleet_by_hour(counts: DataFrame, classes: Sequence[str] = C.MOTOR_CLASSES) -> DataFrame:
    """Densities, shares and flows for every (site, hour), with the measured flag."""
    columns = [*classes, "total", *[f"{c}_fl" for c in classes], "total_fl"]
    filled = fill_hours(fleet_observed(counts, classes), columns)
    total = F.col("total")
    return filled.select(
        F.col("site").alias("site_name"), "hour", rounded("total", 3).alias("total"), "measured", "n_videos",
        *[F.when(total > 0, rounded(F.col(c) / total, 4)).otherwise(0.0).alias(f"{c}_share") for c in classes],
        rounded("total_fl", 3).alias("total_flow_per_min"),
        *[rounded(f"{c}_fl", 3).alias(f"{c}_flow_per_min") for c in classes],
    )


def hour_by_site(fleet: DataFrame, sites: Sequence[str], value: str = "total") -> DataFrame:
    """Printed table: hours down, sites across."""
    return fleet.groupBy("hour").pivot("site_name", list(sites)).agg(F.max(value))


def video_index_summary(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("n"), F.count("latitude").alias("n_located"), (F.sum("duration_s") / 60.0).alias("minutes")
    )


def flow_state(fleet: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Flow of each (site, hour) under each scenario: effective factor, flow shares, source label."""
    rows = with_scenarios(fleet, scenarios)
    k = F.when(F.col("mitigation") == "pedestrian", F.col("traffic") * C.PEDESTRIAN_FACTOR).otherwise(F.col("traffic"))
    flow = F.coalesce(F.col("total_flow_per_min"), F.lit(0.0)) * k
    moto = F.coalesce(F.col("moto_flow_per_min"), F.lit(0.0)) * k
    car = F.coalesce(F.col("car_flow_per_min"), F.lit(0.0)) * k
    rows = rows.withColumn("flow", flow).withColumn(
        "moto_share", F.when(flow > 0, F.least(F.lit(1.0), moto / flow)).otherwise(0.5)
    )
    return rows.select(
        "scenario", "site_name", "hour", "flow", "moto_share",
        F.when(F.col("flow") > 0, F.least(1.0 - F.col("moto_share"), car / F.col("flow"))).otherwise(0.35).alias("car_share"),
        F.when(F.col("measured") == 1, "measured").otherwise("interpolated").alias("traffic_source"),
    )
