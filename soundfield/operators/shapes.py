"""Polygons, envelopes, clipping, hulls, corridors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield.functions import geo
from soundfield.operators.lattice import cell, cells_reached


def square_ring(cx: Column, cy: Column, side: Column) -> Column:
    h = side / 2.0
    return rectangle_ring(cx - h, cy - h, cx + h, cy + h)


def rectangle_ring(x_lo: Column, y_lo: Column, x_hi: Column, y_hi: Column) -> Column:
    corners = [(x_lo, y_lo), (x_hi, y_lo), (x_hi, y_hi), (x_lo, y_hi)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str = "ring", size: float = 1000.0) -> DataFrame:
    """Left join of points to the polygons that contain them.

    Polygons are filed under the cells of their bounding box; merged positions
    are tested against the polygons of their own cell only.
    """
    xs = F.transform(F.col(ring), lambda v: v["x"])
    ys = F.transform(F.col(ring), lambda v: v["y"])
    columns = F.sequence(cell(F.array_min(xs), size), cell(F.array_max(xs), size))
    rows = F.sequence(cell(F.array_min(ys), size), cell(F.array_max(ys), size))
    filed = polygons.withColumn("cx", F.explode(columns)).withColumn("cy", F.explode(rows))
    spots = points.select("x", "y").distinct().withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    hits = spots.join(filed, ["cx", "cy"]).where(geo.ring_contains(F.col(ring), F.col("x"), F.col("y"))).drop("cx", "cy", ring)
    return points.join(hits, ["x", "y"], "left")


def envelope(points: DataFrame, margin: float, key: str = "site") -> DataFrame:
    """Bounding box of each site, widened by the margin."""
    return points.groupBy(key).agg(
        (F.min("x") - margin).alias("x_lo"), (F.min("y") - margin).alias("y_lo"),
        (F.max("x") + margin).alias("x_hi"), (F.max("y") + margin).alias("y_hi"),
    )


def _in_zones(df: DataFrame, zones: DataFrame, x_lo: Column, y_lo: Column, x_hi: Column, y_hi: Column, size: float) -> DataFrame:
    """Rows with every zone their box touches, through cells (no nested loop)."""
    filed = zones.select(
        "*", F.explode(F.sequence(cell(F.col("x_lo"), size), cell(F.col("x_hi"), size))).alias("__cx")
    ).withColumn("__cy", F.explode(F.sequence(cell(F.col("y_lo"), size), cell(F.col("y_hi"), size))))
    boxed = df.select("*", x_lo.alias("__x0"), y_lo.alias("__y0"), x_hi.alias("__x1"), y_hi.alias("__y1"))
    spread = boxed.withColumn(
        "__cx", F.explode(F.sequence(cell(F.col("__x0"), size), cell(F.col("__x1"), size)))
    ).withColumn("__cy", F.explode(F.sequence(cell(F.col("__y0"), size), cell(F.col("__y1"), size))))
    joined = spread.join(filed, ["__cx", "__cy"])
    # one pair may share several cells: keep it in the first cell of the overlap only
    first_x = F.greatest(cell(F.col("__x0"), size), cell(F.col("x_lo"), size))
    first_y = F.greatest(cell(F.col("__y0"), size), cell(F.col("y_lo"), size))
    once = (F.col("__cx") == first_x) & (F.col("__cy") == first_y)
    touches = (
        (F.col("__x0") <= F.col("x_hi")) & (F.col("__x1") >= F.col("x_lo"))
        & (F.col("__y0") <= F.col("y_hi")) & (F.col("__y1") >= F.col("y_lo"))
    )
    return joined.where(once & touches).drop("__cx", "__cy", "__x0", "__y0", "__x1", "__y1")


def clip_points(points: DataFrame, zones: DataFrame, size: float = 2000.0) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _in_zones(points, zones, x, y, x, y, size).drop("x_lo", "y_lo", "x_hi", "y_hi")


def clip_segments(segments: DataFrame, zones: DataFrame, size: float = 2000.0) -> DataFrame:
    """Parts of segments inside each zone box, by the parametric interval of each border."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    near = _in_zones(segments, zones, F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2), size)
    dx, dy = x2 - x1, y2 - y1
    enter, leave, possible = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for step, room in (
        (-dx, x1 - F.col("x_lo")), (dx, F.col("x_hi") - x1), (-dy, y1 - F.col("y_lo")), (dy, F.col("y_hi") - y1),
    ):
        at = room / F.when(step != 0, step)
        enter.append(F.when(step < 0, at))
        leave.append(F.when(step > 0, at))
        possible = possible & ((step != 0) | (room >= 0))
    near = near.withColumn("t0", F.greatest(*enter)).withColumn("t1", F.least(*leave))
    inside = near.where(possible & (F.col("t0") <= F.col("t1")))
    return inside.select(
        *[c for c in inside.columns if c not in ("x1", "y1", "x2", "y2", "x_lo", "y_lo", "x_hi", "y_hi", "t0", "t1")],
        (x1 + F.col("t0") * dx).alias("x1"), (y1 + F.col("t0") * dy).alias("y1"),
        (x1 + F.col("t1") * dx).alias("x2"), (y1 + F.col("t1") * dy).alias("y2"),
    )


def _cut_half_plane(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    other = "y" if axis == "x" else "x"

    def inside(v: Column) -> Column:
        return v[axis] >= bound if keep_above else v[axis] <= bound

    def crossing(p: Column, q: Column) -> Column:
        t = (bound - p[axis]) / F.when(q[axis] != p[axis], q[axis] - p[axis])
        along = p[other] + t * (q[other] - p[other])
        x, y = (bound, along) if axis == "x" else (along, bound)
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def emit(p: Column, q: Column) -> Column:
        return (
            F.when(inside(p) & inside(q), F.array(q))
            .when(inside(p) & ~inside(q), F.array(crossing(p, q)))
            .when(~inside(p) & inside(q), F.array(crossing(p, q), q))
            .otherwise(F.slice(F.array(q), 1, 0))
        )

    def cut(r: Column) -> Column:
        closing = F.concat(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), F.slice(r, 1, 1))
        return F.flatten(F.zip_with(r, closing, emit))

    # bound once as a lambda variable: four nested cuts must not copy each other's text
    return F.get(F.transform(F.array(ring), cut), F.lit(0))


def clip_rings(polygons: DataFrame, zones: DataFrame, ring: str = "ring", size: float = 2000.0) -> DataFrame:
    """Polygons cut to each zone box, border by border, as column expressions."""
    xs = F.transform(F.col(ring), lambda v: v["x"])
    ys = F.transform(F.col(ring), lambda v: v["y"])
    near = _in_zones(polygons, zones, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), size)
    for axis, bound, above in (("x", "x_lo", True), ("x", "x_hi", False), ("y", "y_lo", True), ("y", "y_hi", False)):
        near = near.withColumn(ring, _cut_half_plane(F.col(ring), axis, F.col(bound), above))
    return near.where(F.size(ring) >= 3).drop("x_lo", "y_lo", "x_hi", "y_hi")


def _hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(order: np.ndarray) -> list:
        chain: list = []
        for p in order:
            while len(chain) >= 2:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(tuple(p))
        return chain[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hull_areas(points: DataFrame, key: str = "site", strip: float = 200.0) -> DataFrame:
    """Area of the convex hull of each site's points.

    A hull vertex is the lowest or highest point of its x, and a vertex of the
    hull of any strip that holds it; so strips are hulled first and only their
    vertices meet in the final group.
    """
    extremes = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(key, "x").agg(
        F.array(F.min("y"), F.max("y")).alias("ys")
    ).select(key, "x", F.explode("ys").alias("y"), cell(F.col("x"), strip).alias("strip"))
    kind = dict(points.dtypes)[key]

    def vertices(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "x": hull[:, 0], "y": hull[:, 1]})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf[["x", "y"]].to_numpy())
        shifted = hull - hull[0]
        x, y = shifted[:, 0], shifted[:, 1]
        twice = float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "area_m2": [abs(twice) / 2.0], "n_vertices": [len(hull)]})

    strips = extremes.groupBy(key, "strip").applyInPandas(vertices, f"{key} {kind}, x double, y double")
    return strips.groupBy(key).applyInPandas(area, f"{key} {kind}, area_m2 double, n_vertices bigint")


def corridor(roads: DataFrame, points: DataFrame, radius: float, zone: str = "site") -> DataFrame:
    """Roads of a zone within the radius of any of its points; all its roads if none is.

    A left semi join stops at the first point in reach, so no pairs are formed.
    """
    filed = roads.select(
        "*", F.explode(cells_reached(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), radius)).alias("c")
    ).select("*", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).drop("c")
    spots = points.select(F.col(zone).alias("__zone"), F.col("x").alias("__px"), F.col("y").alias("__py")).distinct()
    spots = spots.withColumn("__cx", cell(F.col("__px"), radius)).withColumn("__cy", cell(F.col("__py"), radius))
    d = geo.segment_distance(F.col("__px"), F.col("__py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    condition = (F.col(zone) == F.col("__zone")) & (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")) & (d <= radius)
    near = filed.join(spots, condition, "left_semi").drop("cx", "cy").distinct()
    # a road reaches several cells, hence the distinct above
    with_any = near.groupBy(zone).agg(F.lit(True).alias("__some"))
    spare = roads.join(with_any, zone, "left_anti")
    return near.unionByName(spare)


def touching_length(queries: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Per distinct query position: whole length of every segment that touches its disc.

    Each segment is filed once under every cell it may reach, a position looks
    only into its own cell, so a pair is met once and needs no distinct.
    """
    length = geo.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    merged = segments.groupBy("x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "length_m", length * F.col("copies")
    )
    filed = merged.select(
        "x1", "y1", "x2", "y2", "length_m",
        F.explode(cells_reached(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), radius)).alias("c"),
    ).select("x1", "y1", "x2", "y2", "length_m", "c.cx", "c.cy")
    spots = queries.select("x", "y").distinct().withColumn("cx", cell(F.col("x"), radius)).withColumn("cy", cell(F.col("y"), radius))
    d = geo.segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return spots.join(filed.hint("merge"), ["cx", "cy"]).where(d <= radius).groupBy("x", "y").agg(F.sum("length_m").alias("length_m"))
