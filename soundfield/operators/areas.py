"""Areas of several parts with holes: which points lie in them, and the sampling frame built on that.

An area is a list of rings, those of its parts and of its holes alike; a point is inside if a ray from it crosses the rings an
odd number of times.  Every area is covered by cells from coarse to fine: a cell that no edge touches lies wholly inside or
wholly outside, one that an edge touches gives way to its quarters, down to the finest level.  Points that meet an inside cell need no test;
those in a finest cell on the boundary are tested against the edges in their own horizontal strip of the area.

No row holds more than the edges of one area in one strip, and neither points nor cells are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield.operators.lattice import cell
from soundfield.session import cut_lineage

#: Cells halve from level to level; the finest have the size that callers give, and strips are as high as they.
LEVELS = 5
#: Metres by which edges are held to reach further, far above rounding; a cell too many on the boundary costs a test only.
NEAR = 1e-6


def edges(areas: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, x1, y1, x2, y2): every edge of every ring, closing ones included; rings of fewer than three corners have none."""
    ring = areas.select(key, F.explode(rings).alias("ring")).where(F.size("ring") >= 3)
    corners = ring.select(key, "ring", F.posexplode("ring").alias("at", "a"))
    following = corners.withColumn("b", F.element_at("ring", F.pmod(F.col("at") + 1, F.size("ring")) + 1))
    return following.select(key, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def strips(lines: DataFrame, key: str, size: float) -> DataFrame:
    """(key, strip, lines): an area's edges that reach into each horizontal strip."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    filed = lines.withColumn("strip", F.explode(F.sequence(cell(low, size), cell(high, size))))
    return filed.groupBy(key, "strip").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("lines"))


def _odd(lines: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses an odd number of the lines; each holds its lower end, not its upper one."""

    def crosses(e: Column) -> Column:
        along = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y1"] != e["y2"], e["y2"] - e["y1"])
        return ((e["y1"] <= y) != (e["y2"] <= y)) & (along > x)

    return F.size(F.filter(lines, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def _touched(lines: DataFrame, key: str, size: float) -> DataFrame:
    """(key, level, cx, cy): the cells of every level that an edge touches, found column by column along the edge."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(size * 2 ** (LEVELS - 1 - k))).alias("width")) for k in range(LEVELS)])
    spread = lines.select("*", F.explode(levels).alias("l")).select("*", "l.*")
    at = lambda v: F.floor(v / F.col("width")).cast("bigint")
    spread = spread.withColumn("cx", F.explode(F.sequence(at(F.least("x1", "x2") - NEAR), at(F.greatest("x1", "x2") + NEAR))))

    def y_at(x: Column) -> Column:
        """Where the edge is at x, or at its nearer end."""
        t = (x - F.col("x1")) / F.when(F.col("x1") != F.col("x2"), F.col("x2") - F.col("x1"))
        return F.col("y1") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (F.col("y2") - F.col("y1"))

    left, right = y_at(F.col("cx") * F.col("width") - NEAR), y_at((F.col("cx") + 1) * F.col("width") + NEAR)
    low = F.when(F.col("x1") == F.col("x2"), F.least("y1", "y2")).otherwise(F.least(left, right))
    high = F.when(F.col("x1") == F.col("x2"), F.greatest("y1", "y2")).otherwise(F.greatest(left, right))
    return spread.select(key, "level", "cx", F.explode(F.sequence(at(low - NEAR), at(high + NEAR))).alias("cy")).distinct()


def cover(areas: DataFrame, key: str, size: float, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """Cells (key, level, cx, cy, inside) that an area fills (`inside`) or, at the finest level, that its boundary touches; and `strips`."""
    lines = edges(areas, key, rings)
    held, touched = cut_lineage(strips(lines, key, size)), cut_lineage(_touched(lines, key, size))  # several joins read both
    box = lines.groupBy(key).agg(
        F.min(F.least("x1", "x2")).alias("x_lo"), F.max(F.greatest("x1", "x2")).alias("x_hi"),
        F.min(F.least("y1", "y2")).alias("y_lo"), F.max(F.greatest("y1", "y2")).alias("y_hi"),
    )
    coarse = size * 2 ** (LEVELS - 1)
    across = F.sequence(cell(F.col("x_lo"), coarse), cell(F.col("x_hi"), coarse))
    up = F.sequence(cell(F.col("y_lo"), coarse), cell(F.col("y_hi"), coarse))
    first = box.select(key, "y_lo", "y_hi", F.explode(across).alias("cx")).select(key, F.lit(0).alias("level"), "cx", F.explode(up).alias("cy"))
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("q")
    parts = touched.where(F.col("level") < LEVELS - 1).select("*", quarter)
    parts = parts.select(key, (F.col("level") + 1).alias("level"), (2 * F.col("cx") + F.col("q.i")).alias("cx"), (2 * F.col("cy") + F.col("q.j")).alias("cy"))
    free = first.unionByName(parts).join(touched, [key, "level", "cx", "cy"], "left_anti")
    width = F.lit(float(size)) * F.pow(F.lit(2.0), LEVELS - 1 - F.col("level"))
    free = free.withColumn("x", (F.col("cx") + 0.5) * width).withColumn("y", (F.col("cy") + 0.5) * width).withColumn("strip", cell(F.col("y"), size))
    filled = free.join(held, [key, "strip"]).where(_odd(F.col("lines"), F.col("x"), F.col("y")))
    rim = touched.where(F.col("level") == LEVELS - 1)
    return filled.select(key, "level", "cx", "cy", F.lit(True).alias("inside")).unionByName(rim.withColumn("inside", F.lit(False))), held


def points_in_areas(points: DataFrame, areas: DataFrame, key: str, size: float = 250.0, rings: str = "rings") -> DataFrame:
    """Left join of points (x, y) to the columns of every area that holds them.

    Points without a position, and points in no area, keep nulls.  A point on an edge belongs to the area above it or to its
    right, so of areas that share an edge one holds it.  Areas without rings hold nothing.
    """
    cells, held = cover(areas, key, size, rings)
    spots = points.select("x", "y").where("x is not null and y is not null").distinct()
    at = [F.struct(F.lit(k).alias("level"), cell(F.col("x"), size * 2 ** (LEVELS - 1 - k)).alias("cx"), cell(F.col("y"), size * 2 ** (LEVELS - 1 - k)).alias("cy")) for k in range(LEVELS)]
    met = spots.select("x", "y", F.explode(F.array(*at)).alias("c")).select("x", "y", "c.*").join(cells, ["level", "cx", "cy"])
    sure = met.where("inside").select("x", "y", key)
    near = met.where("not inside").select("x", "y", key).withColumn("strip", cell(F.col("y"), size)).join(held, [key, "strip"])
    hits = sure.unionByName(near.where(_odd(F.col("lines"), F.col("x"), F.col("y"))).select("x", "y", key))
    return points.join(hits.join(areas.drop(rings), key), ["x", "y"], "left")


def frame_membership(units: DataFrame, developments: DataFrame, key: str, name: str, kind: str = "kind", urban: str = "phuong", size: float = 250.0) -> DataFrame:
    """`units` without rings, with `in_frame`: urban units, and units of the name of one that holds a development (x, y).

    The frame and its complement are the two values of one column, so no unit is in both or in neither.  A unit without a kind
    or a name is in the frame only for the other reason.
    """
    built = points_in_areas(developments.select("x", "y"), units.select(key, name, "rings"), key, size)
    names = built.where(F.col(name).isNotNull()).select(name, F.lit(True).alias("built")).distinct()
    joined = units.drop("rings").join(names, name, "left")
    return joined.withColumn("in_frame", F.coalesce(F.col(kind) == urban, F.lit(False)) | F.coalesce("built", F.lit(False))).drop("built")
