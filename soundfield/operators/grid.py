"""The prediction grid: generation, hours, lookup, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions.geo import distance
from soundfield.operators.scans import attach, with_scalars
from soundfield.operators.shapes import envelope


def grid_layout(points: DataFrame, step: float = C.GRID_STEP_M, margin: float = C.ENVELOPE_MARGIN_M) -> DataFrame:
    """One row per site: origin and number of columns and rows; the upper bound is excluded."""
    box = envelope(points, margin)
    return box.select(
        "site", F.col("x_lo").alias("x0"), F.col("y_lo").alias("y0"), F.lit(float(step)).alias("step"),
        F.ceil((F.col("x_hi") - F.col("x_lo")) / step).cast("bigint").alias("nx"),
        F.ceil((F.col("y_hi") - F.col("y_lo")) / step).cast("bigint").alias("ny"),
    )


def grid_cells(layout: DataFrame) -> DataFrame:
    """Cells of every site; rows are spread before columns so tasks share the work."""
    lines = layout.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ny") - 1)).alias("iy"))
    lines = lines.repartition("site", "iy")
    cells = lines.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1)).alias("ix"))
    return cells.select(
        "site", "ix", "iy",
        (F.col("x0") + F.col("ix") * F.col("step")).alias("x"), (F.col("y0") + F.col("iy") * F.col("step")).alias("y"),
    )


def expand_hours(cells: DataFrame, hours: tuple[int, int] = C.MAP_HOURS) -> DataFrame:
    return cells.withColumn("hour", F.explode(F.sequence(F.lit(hours[0]), F.lit(hours[1]))))


def nearest_cell(points: DataFrame, layout: DataFrame, reach: float | None = None) -> DataFrame:
    """Nearest grid cell of each point over all sites, by lattice arithmetic.

    The grid is regular, so each site offers one candidate: the rounded, clamped
    index.  Halves go down: the first cell in row order wins a tie.  With
    `reach`, a farther cell is refused (nulls).  Sites are few, their layouts
    travel as one array.
    """
    packed = layout.agg(F.sort_array(F.collect_list(F.struct("site", "x0", "y0", "step", "nx", "ny"))).alias("__sites"))

    def candidate(s: Column) -> Column:
        ix = F.least(F.greatest(F.ceil((F.col("x") - s["x0"]) / s["step"] - 0.5), F.lit(0)), s["nx"] - 1).cast("bigint")
        iy = F.least(F.greatest(F.ceil((F.col("y") - s["y0"]) / s["step"] - 0.5), F.lit(0)), s["ny"] - 1).cast("bigint")
        cx, cy = s["x0"] + ix * s["step"], s["y0"] + iy * s["step"]
        return F.struct(
            distance(F.col("x"), F.col("y"), cx, cy).alias("d"), s["site"].alias("site"),
            iy.alias("iy"), ix.alias("ix"),
        )

    joined = with_scalars(points, packed)
    best = joined.withColumn("__c", F.array_min(F.transform("__sites", candidate))).drop("__sites")
    inside = F.lit(True) if reach is None else F.col("__c.d") <= reach
    pick = lambda field: F.when(inside, F.col(f"__c.{field}"))
    return best.select(
        *points.columns, pick("site").alias("cell_site"), pick("ix").alias("ix"), pick("iy").alias("iy"),
        pick("d").alias("cell_dist_m"),
    )


def validate_against_grid(points: DataFrame, layout: DataFrame, grid_levels: DataFrame, hours=C.MAP_HOURS) -> DataFrame:
    """Measurements inside the map hours with the level of their nearest cell at their hour."""
    within = points.where(F.col("hour").between(*hours))
    located = nearest_cell(within, layout)
    sim = grid_levels.select(F.col("site").alias("cell_site"), "ix", "iy", "hour", F.col("level_db").alias("sim_db"))
    return located.join(sim, ["cell_site", "ix", "iy", "hour"]).withColumn("error", F.col("sim_db") - F.col("noise_db"))


def extent_violations(cells: DataFrame, points: DataFrame, margin: float = C.ENVELOPE_MARGIN_M, slack: float = 0.0) -> DataFrame:
    """Cells outside their site's envelope, of unmeasured sites, or with implausible levels."""
    box = envelope(points, margin)
    joined = attach(cells, box, ["site"])
    outside = (
        F.col("x_lo").isNull()
        | (F.col("x") < F.col("x_lo") - slack) | (F.col("x") > F.col("x_hi") + slack)
        | (F.col("y") < F.col("y_lo") - slack) | (F.col("y") > F.col("y_hi") + slack)
    )
    if "level_db" in cells.columns:
        outside = outside | ~((F.col("level_db") > 30) & (F.col("level_db") < 100))
    return joined.where(outside).select(*cells.columns)


def wide_map(grid: DataFrame, keys: Sequence[str] = ("site", "ix", "iy"), hours=C.MAP_HOURS) -> DataFrame:
    """One row per cell, columns h5 .. h21."""
    span = list(range(hours[0], hours[1] + 1))
    wide = grid.groupBy(*keys).pivot("hour", span).agg(F.max("level_db"))
    return wide.select(*keys, *[F.col(str(h)).alias(f"h{h}") for h in span])

