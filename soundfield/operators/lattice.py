"""Radius and nearest-neighbour work as equi-joins on lattice cells.

Catalyst turns `distance(a, b) < r` into a nested loop.  Everything here
rewrites it into equi-joins on square cells, and keeps crowded places from
going quadratic:

* equal positions are merged before any pair is formed;
* sums over a disc take whole cells that lie inside the disc from cell totals,
  and look at single positions only along the rim;
* nearest searches walk down a pyramid of cells and drop every cell that
  cannot hold one of the k nearest;
* tables that grow with the input are merge-joined: Spark guesses the size of
  rows spread over cells from the file they come from, and would send a table
  of a gigabyte to the driver and every task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield.functions.geo import distance, segment_distance
from soundfield.session import cut_lineage

# candidates per position above which a neighbourhood is refined
DENSE_NEIGHBOURHOOD = 4096
# a pyramid leaf should hold about this many targets at most
LEAF_TARGETS = 32
# levels of the pyramid, and after how many of them the pairs are stored, so that plans stay short
LEVELS = 15
STORE_EVERY = 4
MAX_DEPTH = 9


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def around(ix: Column, iy: Column, reach: int = 1) -> Column:
    """Array of the (2 reach + 1)^2 cells around one cell."""
    steps = range(-reach, reach + 1)
    return F.array(*[
        F.struct((ix + dx).cast("bigint").alias("cx"), (iy + dy).cast("bigint").alias("cy"))
        for dx in steps for dy in steps
    ])


# --------------------------------------------------------------------------- disc sums


def _rim_distance(dx: int, dy: int) -> float:
    """Least distance between two cells, in cells."""
    return math.hypot(max(abs(dx) - 1, 0), max(abs(dy) - 1, 0))


def _far_distance(dx: int, dy: int) -> float:
    """Greatest distance between two cells, in cells."""
    return math.hypot(abs(dx) + 1, abs(dy) + 1)


def _inside_offsets(level: int) -> list[tuple[int, int, int, int]]:
    """(parity x, parity y, dx, dy): cells wholly in the disc whose parents are not."""
    radius = 2 ** level * (1 - 1e-12)
    parent = 2 ** (level - 1) * (1 - 1e-12)
    found = []
    for dx in range(-(2 ** level), 2 ** level + 1):
        for dy in range(-(2 ** level), 2 ** level + 1):
            if _far_distance(dx, dy) > radius:
                continue
            for px in (0, 1):
                for py in (0, 1):
                    if level == 0 or _far_distance((px + dx) // 2, (py + dy) // 2) > parent:
                        found.append((px, py, dx, dy))
    return found


def _rim_offsets(level: int) -> list[tuple[int, int]]:
    radius = 2 ** level
    reach = range(-radius - 1, radius + 2)
    return [
        (dx, dy) for dx in reach for dy in reach
        if _rim_distance(dx, dy) < radius and _far_distance(dx, dy) > radius * (1 - 1e-12)
    ]


def _depth(candidates: Column) -> Column:
    """Refinement for a neighbourhood with that many candidates: 0 if it is not dense."""
    wanted = F.ceil(F.log2(candidates / 36.0) / 2)
    odd = wanted + 1 - wanted % 2  # 3, 5, 7, 9: few branches
    return F.when(candidates > DENSE_NEIGHBOURHOOD, F.least(F.greatest(odd, F.lit(3)), F.lit(MAX_DEPTH))).otherwise(0)


def disc_sums(
    queries: DataFrame,
    points: DataFrame,
    radius: float,
    sums: dict[str, Column],
    *,
    strict: bool = True,
    match: Sequence[str] = (),
) -> DataFrame:
    """For every distinct query position: sums over the points within the radius.

    Both inputs carry `x`, `y` and the `match` columns (equal on both sides).
    Positions without a point in reach are absent from the result.
    """
    match = list(match)
    names = list(sums)
    where = queries.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*match, "x", "y").distinct()
    spots = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*match, "x", "y").agg(
        *[F.sum(expr).alias(name) for name, expr in sums.items()]
    )
    where = where.select("*", cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    # read by the load check and by every branch below
    spots = cut_lineage(spots.select("*", cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy")))

    key = [*match, "cx", "cy"]
    spread = spots.groupBy(*key).count().select(*match, F.explode(around(F.col("cx"), F.col("cy"))).alias("c"), "count")
    load = spread.groupBy(*match, F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).agg(F.sum("count").alias("__near"))
    load = load.withColumn("__depth", _depth(F.col("__near")).cast("int"))
    depths = [r[0] for r in load.select("__depth").distinct().collect()]  # at most five values

    if depths in ([], [0]):
        return _plain_disc(where, spots, radius, names, match, strict)
    tagged = cut_lineage(where.join(load.select(*key, "__depth").hint("merge"), key))
    parts = []
    for depth in sorted(depths):
        subset = tagged.where(F.col("__depth") == depth).drop("__depth")
        if depth == 0:
            parts.append(_plain_disc(subset, spots, radius, names, match, strict))
        else:
            parts.append(_refined_disc(subset, spots, radius, names, match, strict, depth))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _within(d: Column, radius: float, strict: bool) -> Column:
    return d < radius if strict else d <= radius


def _plain_disc(where, spots, radius, names, match, strict) -> DataFrame:
    dilated = spots.select(
        *match, F.explode(around(F.col("cx"), F.col("cy"))).alias("c"),
        F.col("x").alias("__px"), F.col("y").alias("__py"), *names,
    ).select(*match, "c.cx", "c.cy", "__px", "__py", *names)
    near = where.join(dilated.hint("merge"), [*match, "cx", "cy"])
    near = near.where(_within(distance(F.col("x"), F.col("y"), F.col("__px"), F.col("__py")), radius, strict))
    return near.groupBy(*match, "x", "y").agg(*[F.sum(n).alias(n) for n in names])


def _refined_disc(where, spots, radius, names, match, strict, depth) -> DataFrame:
    spark = where.sparkSession
    finest = radius / 2 ** depth
    where = where.select(*match, "x", "y", cell(F.col("x"), finest).alias("fx"), cell(F.col("y"), finest).alias("fy"))
    spots = spots.select(
        *match, F.col("x").alias("__px"), F.col("y").alias("__py"), *names,
        cell(F.col("x"), finest).alias("gx"), cell(F.col("y"), finest).alias("gy"),
    )
    totals = spots.groupBy(*match, "gx", "gy").agg(*[F.sum(n).alias(n) for n in names])
    asked = where.select(*match, "fx", "fy").distinct()

    gathered = []
    for level in range(1, depth + 1):
        shrink = depth - level
        stencil = spark.createDataFrame(_inside_offsets(level), "px bigint, py bigint, dx bigint, dy bigint")
        cells = asked.select(
            *match, F.shiftright("fx", shrink).alias("ax"), F.shiftright("fy", shrink).alias("ay")
        ).distinct()
        level_totals = totals.groupBy(
            *match, F.shiftright("gx", shrink).alias("bx"), F.shiftright("gy", shrink).alias("by")
        ).agg(*[F.sum(n).alias(n) for n in names])
        # the stencil has a fixed, small size for a given depth
        pairs = cells.withColumn("px", F.pmod("ax", F.lit(2))).withColumn("py", F.pmod("ay", F.lit(2))).join(
            F.broadcast(stencil), ["px", "py"]
        ).select(*match, "ax", "ay", (F.col("ax") + F.col("dx")).alias("bx"), (F.col("ay") + F.col("dy")).alias("by"))
        inner = pairs.join(level_totals.hint("merge"), [*match, "bx", "by"]).groupBy(*match, "ax", "ay").agg(
            *[F.sum(n).alias(n) for n in names]
        )
        reached = where.withColumn("ax", F.shiftright("fx", shrink)).withColumn("ay", F.shiftright("fy", shrink)).join(
            inner.hint("merge"), [*match, "ax", "ay"]
        )
        gathered.append(reached.select(*match, "x", "y", *names))

    rim = spark.createDataFrame(
        [(px, py, dx, dy) for px in (0, 1) for py in (0, 1) for dx, dy in _rim_offsets(depth)],
        "px bigint, py bigint, dx bigint, dy bigint",
    )
    pairs = asked.withColumn("px", F.pmod("fx", F.lit(2))).withColumn("py", F.pmod("fy", F.lit(2))).join(
        F.broadcast(rim), ["px", "py"]
    ).select(
        *match, "fx", "fy", (F.col("fx") + F.col("dx")).alias("gx"), (F.col("fy") + F.col("dy")).alias("gy")
    )
    pairs = pairs.join(totals.select(*match, "gx", "gy").hint("merge"), [*match, "gx", "gy"], "left_semi")
    edge = where.join(pairs.hint("merge"), [*match, "fx", "fy"]).join(spots.hint("merge"), [*match, "gx", "gy"])
    edge = edge.where(_within(distance(F.col("x"), F.col("y"), F.col("__px"), F.col("__py")), radius, strict))
    gathered.append(edge.groupBy(*match, "x", "y").agg(*[F.sum(n).alias(n) for n in names]))

    out = gathered[0]
    for part in gathered[1:]:
        out = out.unionByName(part)
    return out.groupBy(*match, "x", "y").agg(*[F.sum(n).alias(n) for n in names])


def positions_near(
    left: DataFrame, right: DataFrame, radius: float, *, strict: bool = False, match: Sequence[str] = ()
) -> DataFrame:
    """Pairs of distinct positions within the radius, with their distance.

    For operators whose result is a function of each distance.  Right columns
    get the suffix `_r`; other columns of both sides are kept, so pass merged
    positions.
    """
    match = list(match)
    others = [c for c in right.columns if c not in match]
    a = left.withColumn("__cx", cell(F.col("x"), radius)).withColumn("__cy", cell(F.col("y"), radius))
    b = right.select(
        *match, *[F.col(c).alias(f"{c}_r") for c in others],
        F.explode(around(cell(F.col("x"), radius), cell(F.col("y"), radius))).alias("c"),
    ).select("*", F.col("c.cx").alias("__cx"), F.col("c.cy").alias("__cy")).drop("c")
    d = distance(F.col("x"), F.col("y"), F.col("x_r"), F.col("y_r"))
    joined = a.join(b.hint("merge"), [*match, "__cx", "__cy"]).withColumn("d", d)
    return joined.where(_within(F.col("d"), radius, strict)).drop("__cx", "__cy")


# ----------------------------------------------------------------------- segment covers


def covered_cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Cells a segment passes through: per column of cells, the rows it spans there."""
    slack = 1e-9
    lo_x, hi_x = F.least(x1, x2), F.greatest(x1, x2)
    slope = (y2 - y1) / F.when(x2 != x1, x2 - x1)

    def rows(ix: Column) -> Column:
        left = F.greatest(lo_x, ix * size)
        right = F.least(hi_x, (ix + 1) * size)
        y_left = F.coalesce(y1 + (left - x1) * slope, F.least(y1, y2))
        y_right = F.coalesce(y1 + (right - x1) * slope, F.greatest(y1, y2))
        low, high = F.least(y_left, y_right), F.greatest(y_left, y_right)
        return F.transform(
            F.sequence(cell(low - slack * size, size), cell(high + slack * size, size)),
            lambda iy: F.struct(ix.alias("cx"), iy.alias("cy")),
        )

    return F.flatten(F.transform(F.sequence(cell(lo_x - slack * size, size), cell(hi_x + slack * size, size)), rows))


def cells_reached(x1: Column, y1: Column, x2: Column, y2: Column, radius: float) -> Column:
    """Cells of size `radius` that may hold a point within `radius` of the segment."""
    dilated = F.flatten(F.transform(covered_cells(x1, y1, x2, y2, radius), lambda c: around(c["cx"], c["cy"])))
    return F.array_distinct(dilated)


# ------------------------------------------------------------------------ nearest search


def _pyramid_sizes(targets: DataFrame, queries: DataFrame, leaf_targets: int) -> list[float]:
    """Cell sizes from one that spans everything down to sparse leaves, each half of the last.

    Reads one row of bounds and at most LEVELS rows of occupancies.
    """
    extent = targets.select("x", "y").unionByName(queries.select("x", "y"))
    box = extent.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return [1.0]
    span = max(box[1] - box[0], box[3] - box[2], 1.0)
    root = 2.0 ** math.ceil(math.log2(span))
    sizes = [root / 2 ** k for k in range(LEVELS)]
    finest = sizes[-1]
    fine = targets.groupBy(cell(F.col("x"), finest).alias("ix"), cell(F.col("y"), finest).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    stacked = fine.select(
        F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("k"), "ix", "iy", "n"
    ).selectExpr("k", f"shiftright(ix, {LEVELS - 1} - k) as ix", f"shiftright(iy, {LEVELS - 1} - k) as iy", "n")
    fullest = stacked.groupBy("k", "ix", "iy").agg(F.sum("n").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    crowd = {r["k"]: r["n"] for r in fullest.collect()}
    for k in range(LEVELS):
        if crowd.get(k, 0) <= leaf_targets:
            return sizes[: k + 1]
    return sizes


def _descend(
    asked: DataFrame,
    held: DataFrame,
    sizes: list[float],
    k: int,
    *,
    keys: Sequence[str],
    fold: bool,
    buffer: float | None,
) -> DataFrame:
    """Pairs of leaf cells (ax, ay) -> (bx, by) that can hold one of the k nearest.

    `asked`: keys, [fold], ax, ay of the leaves with queries.
    `held`: keys, bx, by, n [, by_fold map] of the leaves with targets.
    With `fold`, targets of the query's own fold do not count.  With `buffer`,
    only targets farther than the buffer count.

    A level halves the cells of the last, so a pair has at most 16 children; those
    beyond the distance that already sufficed for their parent go before the shuffle.
    """
    keys = list(keys)
    group = [*keys, "fold"] if fold else keys
    deepest = len(sizes) - 1
    # read at every level
    asked, held = cut_lineage(asked), cut_lineage(held)
    pairs = None
    for level, size in enumerate(sizes):
        shrink = deepest - level
        a = asked.select(
            *group, F.shiftright("ax", shrink).alias("ax"), F.shiftright("ay", shrink).alias("ay")
        ).distinct()
        b = held.withColumn("bx", F.shiftright("bx", shrink)).withColumn("by", F.shiftright("by", shrink))
        if fold:
            counted = b.groupBy(*keys, "bx", "by", "fold").agg(F.sum("n").alias("n"))
            b = counted.groupBy(*keys, "bx", "by").agg(
                F.sum("n").alias("n"),
                F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("by_fold"),
            )
        else:
            b = b.groupBy(*keys, "bx", "by").agg(F.sum("n").alias("n"))
        if pairs is None:
            near = a.withColumn("c", F.explode(around(F.col("ax"), F.col("ay")))).select(
                *group, "ax", "ay", F.col("c.cx").alias("bx"), F.col("c.cy").alias("by"), F.lit(None).cast("double").alias("__limit")
            )
            pairs = near.join(b.hint("merge"), [*keys, "bx", "by"])
        else:
            children = a.withColumn("ux", F.shiftright("ax", 1)).withColumn("uy", F.shiftright("ay", 1))
            up = pairs.select(*group, F.col("ax").alias("ux"), F.col("ay").alias("uy"), F.col("bx").alias("vx"), F.col("by").alias("vy"), "__limit")
            b = b.withColumn("vx", F.shiftright("bx", 1)).withColumn("vy", F.shiftright("by", 1))
            pairs = up.join(children.hint("merge"), [*group, "ux", "uy"]).join(b.hint("merge"), [*keys, "vx", "vy"]).drop("ux", "uy", "vx", "vy")
        eligible = F.col("n")
        if fold:
            eligible = eligible - F.coalesce(F.try_element_at("by_fold", F.col("fold")), F.lit(0))
        gap_x, gap_y = F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))
        zero = F.lit(0).cast("bigint")
        near_d = F.hypot(F.greatest(gap_x - 1, zero), F.greatest(gap_y - 1, zero)) * size
        far_d = F.hypot(gap_x + 1, gap_y + 1) * size
        within = F.col("__limit").isNull() | (F.col("__near") <= F.col("__limit") * (1 + 1e-9) + 1e-6)
        pairs = pairs.withColumn("n", eligible).where("n > 0").withColumn("__near", near_d).withColumn("__far", far_d).where(within)
        sure = F.col("n")
        if buffer is not None:
            pairs = pairs.where(F.col("__far") > buffer)
            sure = F.when(F.col("__near") > buffer, F.col("n")).otherwise(0)
        pairs = pairs.select(*group, "ax", "ay", "bx", "by", "__near", "__far", sure.alias("__sure"))
        window = Window.partitionBy(*group, "ax", "ay")
        if k > 1:
            pairs = pairs.withColumn("__sure", F.sum("__sure").over(window.orderBy("__far")))
        limit = F.min(F.when(F.col("__sure") >= k, F.col("__far"))).over(window)
        pairs = pairs.withColumn("__limit", limit).where(within).select(*group, "ax", "ay", "bx", "by", "__limit")
        if level % STORE_EVERY == STORE_EVERY - 1 or level == deepest:
            pairs = cut_lineage(pairs)
    return pairs.drop("__limit")


def nearest_points(
    queries: DataFrame,
    points: DataFrame,
    k: int = 1,
    *,
    fold: str | None = None,
    buffer: float | None = None,
    tie: str = "seq",
    leaf_targets: int = LEAF_TARGETS,
) -> DataFrame:
    """The k nearest points of every distinct query position.

    Inputs carry `x`, `y`; points also carry `tie`, the order that settles
    equal distances.  With `fold`, both sides carry that column and only points
    of other folds are eligible; with `buffer`, only points farther than it.
    Result: x, y [, fold], rank (1..k), d and the other point columns.
    """
    by_fold = fold is not None
    group = ["fold"] if by_fold else []
    located = F.col("x").isNotNull() & F.col("y").isNotNull()
    q = queries.where(located).select(*([F.col(fold).alias("fold")] if by_fold else []), "x", "y").distinct()
    p = points.where(located)
    if by_fold and fold != "fold":
        p = p.withColumnRenamed(fold, "fold")
    # no more than k points of one position (and fold) can be among the k nearest
    same = Window.partitionBy(*group, "x", "y").orderBy(tie)
    p = p.withColumn("__same", F.row_number().over(same)).where(F.col("__same") <= k).drop("__same")
    q, p = cut_lineage(q), cut_lineage(p)
    sizes = _pyramid_sizes(p, q, max(leaf_targets, k))
    leaf = sizes[-1]
    q = q.withColumn("ax", cell(F.col("x"), leaf)).withColumn("ay", cell(F.col("y"), leaf))
    carried = [c for c in p.columns if c not in ("x", "y", "fold")]
    p = p.withColumn("bx", cell(F.col("x"), leaf)).withColumn("by", cell(F.col("y"), leaf))
    asked = q.select(*group, "ax", "ay").distinct()
    held = p.groupBy(*group, "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    pairs = _descend(asked, held, sizes, k, keys=[], fold=by_fold, buffer=buffer)

    targets = p.select(
        "bx", "by", F.col("x").alias("__px"), F.col("y").alias("__py"), *carried,
        *([F.col("fold").alias("__pf")] if by_fold else []),
    )
    found = q.join(pairs.hint("merge"), [*group, "ax", "ay"]).join(targets.hint("merge"), ["bx", "by"])
    if by_fold:
        found = found.where(F.col("__pf") != F.col("fold"))
    found = found.withColumn("d", distance(F.col("x"), F.col("y"), F.col("__px"), F.col("__py")))
    if buffer is not None:
        found = found.where(F.col("d") > buffer)
    order = Window.partitionBy(*group, "x", "y").orderBy("d", tie)
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*group, "x", "y", "rank", "d", *carried)
    )


def nearest_segments(
    queries: DataFrame, segments: DataFrame, kinds: Sequence[str], *, leaf_targets: int = LEAF_TARGETS
) -> DataFrame:
    """Distance from every distinct query position to the nearest segment of each kind.

    `segments`: x1, y1, x2, y2 and `kind`, one of `kinds`.  Result: x, y, kind, d.
    A kind without any segment gives no row.
    """
    located = F.col("x").isNotNull() & F.col("y").isNotNull()
    q = cut_lineage(queries.where(located).select("x", "y").distinct())
    s = cut_lineage(segments.select("kind", "x1", "y1", "x2", "y2").distinct())
    middles = s.select(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    ends = s.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(
        s.select(F.col("x2").alias("x"), F.col("y2").alias("y"))
    )
    sizes = _pyramid_sizes(middles, q.unionByName(ends), leaf_targets)
    leaf = sizes[-1]
    pieces = s.withColumn(
        "c", F.explode(covered_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), leaf))
    ).select("kind", "x1", "y1", "x2", "y2", F.col("c.cx").alias("bx"), F.col("c.cy").alias("by"))
    q = q.withColumn("ax", cell(F.col("x"), leaf)).withColumn("ay", cell(F.col("y"), leaf))
    asked = q.select("ax", "ay").distinct().withColumn("kind", F.explode(F.array(*[F.lit(v) for v in kinds])))
    held = pieces.groupBy("kind", "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    pairs = _descend(asked, held, sizes, 1, keys=["kind"], fold=False, buffer=None)
    found = q.join(pairs.hint("merge"), ["ax", "ay"]).join(pieces.hint("merge"), ["kind", "bx", "by"])
    d = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    # a small table that callers read many times
    return cut_lineage(found.groupBy("x", "y", "kind").agg(F.min(d).alias("d")))
