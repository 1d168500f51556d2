"""Traffic, mitigation and construction scenarios over a noise grid.

Grid rows: site, x, y, hour, level_db, d_hw, d_res (one row per cell and hour).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions import levels
from soundfield.operators.lattice import positions_near
from soundfield.operators.quantiles import order_statistic


@dataclass(frozen=True)
class Scenario:
    """`mitigation` is none, zone30 or pedestrian; `traffic` multiplies the volume."""

    name: str
    traffic: float = 1.0
    mitigation: str = "none"


def with_scenarios(df: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Repeat each row for each scenario, as a literal array: no join."""
    items = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.lit(float(s.traffic)).alias("traffic"), F.lit(s.mitigation).alias("mitigation"))
        for s in scenarios
    ])
    return df.withColumn("__s", F.explode(items)).select(*df.columns, "__s.scenario", "__s.traffic", "__s.mitigation")


def major_share(d_hw: Column, d_res: Column, a_hw: float, a_res: float, floor: float = C.KERNEL_FLOOR_M) -> Column:
    """Share of traffic energy that comes from major roads."""
    if a_hw + a_res <= 0:
        return F.lit(0.5)
    e_hw = F.lit(a_hw) / F.greatest(d_hw, F.lit(floor))
    e_res = F.lit(a_res) / F.greatest(d_res, F.lit(floor))
    return F.when(e_hw + e_res > 0, e_hw / (e_hw + e_res)).otherwise(0.5)


def ambience(grid: DataFrame, share: float = C.AMBIENT_SHARE) -> DataFrame:
    """Level of the quiet end of each (site, hour): an order statistic, not interpolated."""
    return order_statistic(grid, ["site", "hour"], "level_db", share, "ambient_db")


def decompose(grid: DataFrame, share_hw: Column, ambient: DataFrame | None = None) -> DataFrame:
    """Adds e_ambient, e_major, e_minor: residual energy and the two traffic parts of each cell."""
    quiet = ambience(grid) if ambient is None else ambient
    total = levels.to_energy(F.col("level_db"))
    joined = grid.join(quiet, ["site", "hour"]).withColumn("e_ambient", F.least(levels.to_energy(F.col("ambient_db")), total))
    traffic = total - F.col("e_ambient")
    return joined.withColumn("e_major", traffic * share_hw).withColumn("e_minor", traffic * (1.0 - share_hw))


def apply_scenarios(decomposed: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Background level of each cell and hour under each scenario."""
    rows = with_scenarios(decomposed, scenarios)
    k = F.col("traffic")
    local = (
        F.when((F.col("mitigation") == "zone30") & (F.col("d_res") <= C.ZONE30_REACH_M), k * (10 ** (C.ZONE30_DB / 10)))
        .when(F.col("mitigation") == "pedestrian", k * C.PEDESTRIAN_FACTOR)
        .otherwise(k)
    )
    energy = F.col("e_ambient") + k * F.col("e_major") + local * F.col("e_minor")
    return rows.withColumn("background_db", 10.0 * F.log10(energy))


def scaled_level(level: Column, multiplier: Column, ambient_energy: Column) -> Column:
    """Level after scaling the part of the energy above the ambience."""
    energy = levels.to_energy(level)
    rest = F.least(ambient_energy, energy)
    return 10.0 * F.log10(rest + multiplier * (energy - rest))


def construction_energies(cells: DataFrame, sources: DataFrame, radius: float = C.CONSTRUCTION_RADIUS_M) -> DataFrame:
    """Energy each cell position receives from the sources within the radius.

    Sources at one position are merged, so a register full of copies stays small.
    """
    merged = sources.groupBy("x", "y").agg(F.count(F.lit(1)).alias("copies"))
    spots = cells.select("x", "y").distinct()
    near = positions_near(spots, merged, radius)
    return near.groupBy("x", "y").agg(
        F.sum(levels.construction_energy(F.col("d")) * F.col("copies_r")).alias("construction_energy"),
        F.sum("copies_r").alias("n_sources"),
    )


def with_construction(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds construction_energy to cells (or grid rows); do it before hours and scenarios multiply them."""
    got = construction_energies(cells, sources).drop("n_sources")
    return cells.join(got, ["x", "y"], "left").withColumn("construction_energy", F.coalesce("construction_energy", F.lit(0.0)))


def overlay_construction(rows: DataFrame, start: int, end: int, background: str = "background_db") -> DataFrame:
    """Adds effective_db: background plus the sites at work during working hours."""
    extra = F.when(F.col("hour").between(start, end), F.col("construction_energy")).otherwise(0.0)
    return rows.withColumn("effective_db", 10.0 * F.log10(levels.to_energy(F.col(background)) + extra))


def zone_indicators(rows: DataFrame, keys: Sequence[str] = ("scenario", "site", "hour"), level: str = "effective_db") -> DataFrame:
    v = F.col(level)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.avg(v).alias("mean_db"), F.max(v).alias("peak_db"),
        (100.0 * F.avg((v > C.LIMIT_DAY).cast("double"))).alias("pct_over_day"),
        (100.0 * F.avg((v > C.LIMIT_NIGHT).cast("double"))).alias("pct_over_night"),
        F.avg(F.col("background_db") - F.col("level_db")).alias("mean_shift_db"),
    )


def near_source_mean(
    rows: DataFrame, sources: DataFrame, keys: Sequence[str], level: str = "effective_db", radius: float = C.CONSTRUCTION_NEAR_M
) -> DataFrame:
    """Mean level of the cells nearer than the radius to any source."""
    near = near_positions(rows, sources, radius)
    return rows.join(near, ["x", "y"], "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.avg(level).alias("mean_db")
    )


def near_positions(rows: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """Distinct positions with a source nearer than the radius (semi join: stops at the first)."""
    from soundfield.functions.geo import distance
    from soundfield.operators.lattice import around, cell

    spots = rows.select("x", "y").distinct().withColumn("cx", cell(F.col("x"), radius)).withColumn("cy", cell(F.col("y"), radius))
    there = sources.select("x", "y").distinct().select(
        F.col("x").alias("sx"), F.col("y").alias("sy"),
        F.explode(around(cell(F.col("x"), radius), cell(F.col("y"), radius))).alias("c"),
    ).select("sx", "sy", F.col("c.cx").alias("scx"), F.col("c.cy").alias("scy"))
    condition = (F.col("cx") == F.col("scx")) & (F.col("cy") == F.col("scy")) & (
        distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) < radius
    )
    return spots.join(there, condition, "left_semi").select("x", "y")
