"""Street-geometry features of positions: morphology within a radius, distances to roads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions import timing
from soundfield.operators import polylines
from soundfield.operators.lattice import disc_sums, nearest_segments
from soundfield.operators.shapes import touching_length


def disc_morphology(points: DataFrame, buildings: DataFrame, nodes: DataFrame, radius: float = C.FEATURE_RADIUS_M) -> DataFrame:
    """Per distinct position: built area ratio (at most 1), building density per km2, intersections."""
    area = math.pi * radius ** 2
    built = disc_sums(points, buildings, radius, {"built_m2": F.col("area_m2"), "n_buildings": F.lit(1).cast("bigint")})
    crossing = disc_sums(points, nodes, radius, {"intersection_count": F.lit(1).cast("bigint")})
    spots = points.select("x", "y").distinct()
    out = spots.join(built, ["x", "y"], "left").join(crossing, ["x", "y"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "x", "y",
        F.least(F.coalesce(F.col("built_m2"), F.lit(0.0)) / area, F.lit(1.0)).alias("built_area_ratio"),
        (F.coalesce(F.col("n_buildings"), zero) / (area / 1e6)).alias("building_density_km2"),
        F.coalesce(F.col("intersection_count"), zero).alias("intersection_count"),
    )


def road_density(points: DataFrame, roads: DataFrame, radius: float = C.FEATURE_RADIUS_M) -> DataFrame:
    """km of road per km2: every road that touches the disc counts with its whole length.

    `roads` has either `line`, its vertices, or the ends x1, y1, x2, y2.
    """
    area_km2 = math.pi * radius ** 2 / 1e6
    touching = polylines.touching_length if "line" in roads.columns else touching_length
    got = touching(points, roads, radius)
    return points.select("x", "y").distinct().join(got, ["x", "y"], "left").select(
        "x", "y", (F.coalesce("length_m", F.lit(0.0)) / 1000.0 / area_km2).alias("road_density_km_km2")
    )


def road_distances(points: DataFrame, roads: DataFrame, absent: float = C.ROAD_ABSENT_M) -> DataFrame:
    """Distance to the nearest road, major road and minor road; `absent` where a class has none.

    `roads` has `kind`, and either `line`, its vertices, or the ends x1, y1, x2, y2.
    """
    lines = polylines.pieces(roads.select("kind", "line")) if "line" in roads.columns else roads
    near = nearest_segments(points, lines, ["major", "minor"])
    wide = near.groupBy("x", "y").agg(
        F.min("d").alias("any"),
        F.min(F.when(F.col("kind") == "major", F.col("d"))).alias("hw"),
        F.min(F.when(F.col("kind") == "minor", F.col("d"))).alias("res"),
    )
    filled = lambda c: F.coalesce(F.col(c), F.lit(float(absent)))
    return points.select("x", "y").distinct().join(wide, ["x", "y"], "left").select(
        "x", "y", filled("any").alias("dist_road_m"), filled("hw").alias("dist_highway_m"), filled("res").alias("dist_residential_m")
    )


def morphology(points: DataFrame, buildings: DataFrame, nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """All street-geometry features per distinct position."""
    return (
        disc_morphology(points, buildings, nodes)
        .join(road_density(points, roads), ["x", "y"])
        .join(road_distances(points, roads), ["x", "y"])
    )


def time_features(df: DataFrame, hour: str = "hour") -> DataFrame:
    return df.withColumn("hour_sin", timing.hour_sin(F.col(hour))).withColumn("hour_cos", timing.hour_cos(F.col(hour)))


def with_block(df: DataFrame, size: float = C.BLOCK_M) -> DataFrame:
    """Adds the integer block coordinates and their text id."""
    block_x, block_y = F.floor(F.col("x") / size).cast("bigint"), F.floor(F.col("y") / size).cast("bigint")
    return df.withColumn("block_x", block_x).withColumn("block_y", block_y).withColumn("block", F.concat_ws("_", block_x.cast("string"), block_y.cast("string")))


def log_distance(d: Column) -> Column:
    return F.log10(F.greatest(d, F.lit(1.0)))
