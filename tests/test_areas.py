import numpy as np
import pytest
from pyspark.sql import functions as F

from soundfield.operators import areas
from soundfield.plans import ORACLES, QUERIES

SCHEMA = "name string, kind string, rings array<array<struct<x:double,y:double>>>"


def inside(rings, x, y):
    """Even-odd by every edge."""
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                odd = not odd
    return odd


def star(rng, cx, cy, r, n):
    return [(float(cx + r * f * np.cos(t)), float(cy + r * f * np.sin(t))) for t, f in zip(np.linspace(0, 2 * np.pi, n, endpoint=False), rng.uniform(0.4, 1, n), strict=True)]


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(3)
    held = []
    for k in range(6):
        cx, cy = rng.uniform(-800, 800, 2)
        parts = [star(rng, cx, cy, 700, 40), star(rng, cx, cy, 250, 12), star(rng, cx, cy, 90, 7), star(rng, cx + 1500, cy, 200, 9)]
        held.append((f"a{k}", "xa" if k % 2 else "phuong", parts))
    held += [("empty", "xa", []), ("line", "xa", [[(0.0, 0.0), (5.0, 5.0)]]), ("none", "xa", None)]
    return held, spark.createDataFrame(held, SCHEMA).withColumn("id", F.monotonically_increasing_id())


@pytest.mark.parametrize("size", [20.0, 300.0])
def test_points_in_areas_equal_brute_force(spark, shapes, size):
    held, df = shapes
    rng = np.random.default_rng(4)
    xy = [(float(x), float(y)) for x, y in rng.uniform(-2500, 3500, (3000, 2))]
    corners = [c for _, _, rings in held for r in rings or [] for c in r]
    rows = [(i, x, y) for i, (x, y) in enumerate(xy + corners + xy[:5])] + [(-1, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double").withColumnRenamed("id", "p")
    got = sorted((r.p, r.name or "") for r in areas.points_in_areas(points, df, "id", size).collect())
    want = sorted((i, name) for i, x, y in rows for name in ([n for n, _, rings in held if x is not None and inside(rings or [], x, y)] or [""]))
    assert got == want and sum(n != "" for _, n in got) > 300


def test_a_cell_wholly_inside_needs_no_edges(spark):
    square = [(0.0, 0.0), (10000.0, 0.0), (10000.0, 10000.0), (0.0, 10000.0)]
    df = spark.createDataFrame([("s", "xa", [square])], SCHEMA)
    cells, held = areas.cover(df, "name", 100.0)
    by_level = {(r.level, r.inside): r.n for r in cells.groupBy("level", "inside").agg(F.count("*").alias("n")).collect()}
    assert by_level[0, True] >= 25 and by_level[4, False] <= 1000 and sum(by_level.values()) < 2500  # ten thousand finest cells
    assert held.agg(F.max(F.size("lines"))).first()[0] <= 4


def test_points_of_one_cell_do_not_multiply(spark, shapes):
    _, df = shapes
    crowd = spark.range(20000).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), "id").withColumnRenamed("id", "p")
    assert areas.points_in_areas(crowd, df, "id").groupBy("p").count().count() == 20000


def test_frame_and_complement(spark, shapes):
    held, df = shapes
    developments = [(c[0] + 0.01, c[1]) for _, kind, rings in held[1:2] for r in rings[:1] for c in [tuple(np.mean(rings[3], axis=0))]]
    spots = spark.createDataFrame([(float(x), float(y)) for x, y in developments], "x double, y double")
    units = df.unionByName(df.where("name = 'a1'").withColumn("rings", F.lit(None).cast("array<array<struct<x:double,y:double>>>")))
    got = [(r.name, r.kind, r.in_frame) for r in areas.frame_membership(units, spots, "id", "name").collect()]
    built = {n for n, _, rings in held for x, y in developments if inside(rings or [], x, y)}
    assert len(got) == 10 and built >= {"a1"}
    assert all(f == (k == "phuong" or n in built) for n, k, f in got) and {f for *_, f in got} == {True, False}
    assert areas.frame_membership(units.limit(0), spots, "id", "name").count() == 0
    assert areas.frame_membership(units, spots.limit(0), "id", "name").where("in_frame").count() == 3


def test_the_queries_give_rows_on_both_sides(spark, small):
    assert {"points_in_ward_areas", "frame_wards", "frame_measurements", "wards_outside_frame"} <= set(ORACLES)
    frame = QUERIES["frame_wards"](spark, small)
    assert {r.in_frame for r in frame.collect()} == {True, False}
    assert QUERIES["wards_outside_frame"](spark, small).count() == frame.where("not in_frame").count() > 0
