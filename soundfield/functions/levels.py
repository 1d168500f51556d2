"""Sound levels: decibels, energies, limits and bands as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundfield import config as C


def to_energy(level: Column) -> Column:
    """10^(L/10)."""
    return F.pow(F.lit(10.0), level / 10.0)


def to_level(energy: Column) -> Column:
    """Level of an energy; null where there is no energy."""
    return F.when(energy > 0, 10.0 * F.log10(energy))


def to_level_floored(energy: Column, floor: float = 1e-9) -> Column:
    """Level of an energy, never below the level of `floor`."""
    return 10.0 * F.log10(F.greatest(energy, F.lit(floor)))


def energy_mean_level(level: Column) -> Column:
    """Aggregate: equivalent level, the mean taken on energies."""
    return 10.0 * F.log10(F.avg(to_energy(level)))


def is_night(hour: Column, start: int = 21, end: int = 6) -> Column:
    return (hour >= start) | (hour < end)


def period(hour: Column, start: int = 21, end: int = 6) -> Column:
    return F.when(is_night(hour, start, end), "night").otherwise("day")


def limit_for(hour: Column) -> Column:
    return F.when(is_night(hour), float(C.LIMIT_NIGHT)).otherwise(float(C.LIMIT_DAY))


def band(value: Column, edges: Sequence[float]) -> Column:
    """0 below the first edge, k from the k-th edge on."""
    expr = F.lit(0)
    for i, edge in enumerate(edges, start=1):
        expr = F.when(value >= edge, i).otherwise(expr)
    return F.when(value.isNotNull(), expr)


FIELD_MAP_EDGES = (60.0, 70.0, 80.0)
LEGEND_EDGES = tuple(float(v) for v in range(50, 85, 5))
ZONE_EDGES = (60.0, 65.0, 70.0, 75.0)


def construction_energy(distance: Column) -> Column:
    """Energy received from an active site, spherical spreading, floored distance."""
    d = F.greatest(distance, F.lit(C.CONSTRUCTION_MIN_M))
    return to_energy(F.lit(C.CONSTRUCTION_REF_DB) - 20.0 * F.log10(d / C.CONSTRUCTION_REF_M))


def heat_scale(value: Column, low: Column, high: Column) -> Column:
    """Clip a value between two quantiles and stretch it to 0..1."""
    width = F.when(high - low != 0, high - low).otherwise(F.lit(1.0))
    return F.least(F.greatest((value - low) / width, F.lit(0.0)), F.lit(1.0))
