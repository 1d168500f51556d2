import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundfield.functions import geo
from soundfield.operators import describe, grid, matching, scenario, shapes, traffic
from soundfield.operators.scenario import Scenario


def ring(*xy):
    return [(float(x), float(y)) for x, y in xy]


def test_points_in_a_concave_polygon(spark):
    polygons = spark.createDataFrame([("u", ring((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10)))], "name string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 9.0), (3, 8.5, 5.0), (4, 50.0, 5.0)], "id int, x double, y double")
    got = {r.id: r.name for r in shapes.points_in_polygons(points, polygons, size=4.0).collect()}
    assert got == {1: None, 2: "u", 3: "u", 4: None}


def test_ring_measures(spark):
    df = spark.createDataFrame([(ring((0, 0), (4, 0), (4, 3)),)], "ring array<struct<x:double,y:double>>")
    cx, cy = geo.ring_centroid(F.col("ring"))
    r = df.select(geo.ring_area(F.col("ring")).alias("a"), cx.alias("cx"), cy.alias("cy"), geo.polyline_length(F.col("ring")).alias("l")).first()
    assert (r.a, r.cx, r.cy, r.l) == (pytest.approx(6), pytest.approx(8 / 3), pytest.approx(1), pytest.approx(7))


def test_clipping(spark):
    zone = spark.createDataFrame([("z", 0.0, 0.0, 10.0, 10.0)], "site string, x_lo double, y_lo double, x_hi double, y_hi double")
    seg = spark.createDataFrame([(1, -5.0, 5.0, 15.0, 5.0), (2, 20.0, 0.0, 20.0, 9.0), (3, 2.0, 2.0, 2.0, 2.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (r.x1, r.x2) for r in shapes.clip_segments(seg, zone, 3.0).collect()}
    assert got == {1: (0.0, 10.0), 3: (2.0, 2.0)}
    tri = spark.createDataFrame([(1, ring((-10, 0), (10, 0), (0, 20)))], "id int, ring array<struct<x:double,y:double>>")
    area = shapes.clip_rings(tri, zone, size=3.0).select(geo.ring_area(F.col("ring")).alias("a")).first().a
    assert area == pytest.approx(75.0)


@pytest.mark.parametrize("strip", [3.0, 1000.0])
def test_hull(spark, strip):
    rng = np.random.default_rng(0)
    xy = np.vstack([rng.uniform(1, 9, (200, 2)), [[0, 0], [10, 0], [10, 10], [0, 10]]])
    df = spark.createDataFrame(pd.DataFrame({"site": "a", "x": xy[:, 0], "y": xy[:, 1]}))
    r = shapes.hull_areas(df, strip=strip).first()
    assert r.area_m2 == pytest.approx(100) and r.n_vertices == 4


def test_corridor_falls_back_to_all_roads(spark):
    roads = spark.createDataFrame([(1, "a", 0.0, 0.0, 100.0, 0.0), (2, "a", 0.0, 900.0, 10.0, 900.0), (3, "b", 5000.0, 0.0, 5100.0, 0.0)],
                                  "id int, site string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([("a", 50.0, 149.0), ("b", 9000.0, 9000.0)], "site string, x double, y double")
    assert sorted(r.id for r in shapes.corridor(roads, points, 150.0).collect()) == [1, 3]


def test_grid_bounds_and_ties(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 100.0, 50.0)], "site string, x double, y double")
    layout = grid.grid_layout(points)
    r = layout.first()
    assert (r.nx, r.ny) == (len(np.arange(-400, 500, 40)), len(np.arange(-400, 450, 40)))
    cells = grid.grid_cells(layout)
    assert cells.count() == r.nx * r.ny
    probe = spark.createDataFrame([(1, -380.0, -400.0), (2, 5000.0, -400.0)], "id int, x double, y double")
    got = {q.id: q for q in grid.nearest_cell(probe, layout).collect()}
    assert (got[1].ix, got[1].iy, got[1].cell_dist_m) == (0, 0, 20.0)
    refused = {q.id: q.ix for q in grid.nearest_cell(probe, layout, reach=80.0).collect()}
    assert refused == {1: 0, 2: None}
    bad = cells.limit(1).withColumn("level_db", F.lit(20.0))
    assert grid.extent_violations(bad, points).count() == 1
    assert grid.extent_violations(cells, points).count() == 0


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    n = 200
    return spark.createDataFrame(pd.DataFrame({
        "site": "a", "hour": 8, "x": rng.uniform(0, 900, n), "y": rng.uniform(0, 900, n), "level_db": rng.uniform(45, 80, n),
        "d_hw": rng.uniform(1, 500, n), "d_res": rng.uniform(1, 300, n),
    }))


def test_scenarios(cells):
    share = scenario.major_share(F.col("d_hw"), F.col("d_res"), 4e7, 3e7)
    parts = scenario.decompose(cells, share)
    rows = scenario.apply_scenarios(parts, [Scenario("one"), Scenario("ten", 10.0), Scenario("z", 1.0, "zone30"), Scenario("p", 1.0, "pedestrian")])
    got = rows.withColumn("shift", F.col("background_db") - F.col("level_db")).toPandas().set_index("scenario")
    assert np.allclose(got.loc["one", "shift"], 0, atol=1e-9)
    assert (got.loc["ten", "shift"] < 10).all() and (got.loc["ten", "shift"] >= -1e-9).all()
    z = got.loc["z"]
    assert np.allclose(z[z.d_res > 150]["shift"], 0, atol=1e-9) and (z[z.d_res <= 150]["shift"] <= 1e-9).all() and (z["shift"] > -3.001).all()
    assert got.loc["p", "shift"].mean() < z["shift"].mean()


def test_construction_overlay(spark, cells):
    sources = spark.createDataFrame([(450.0, 450.0)] * 3, "x double, y double")
    rows = scenario.with_construction(cells, sources).withColumn("background_db", F.col("level_db")).withColumn("scenario", F.lit("s"))
    quiet = scenario.overlay_construction(rows, 10, 12).where("effective_db > background_db + 1e-9").count()
    loud = scenario.overlay_construction(rows, 8, 12).where("effective_db > background_db + 1e-9").toPandas()
    d = np.hypot(loud.x - 450, loud.y - 450)
    assert quiet == 0 and len(loud) and (d <= 250).all()
    first = loud.iloc[0]
    e = 3 * 10 ** ((64.7 - 20 * np.log10(max(d.iloc[0], 25) / 56)) / 10)
    assert first.effective_db == pytest.approx(10 * np.log10(10 ** (first.level_db / 10) + e))


def test_nearest_in_time(spark):
    rng = np.random.default_rng(0)
    left = pd.DataFrame({"v": range(300), "a": np.sort(rng.integers(0, 10**10, 300))})
    right = pd.DataFrame({"seq": range(400), "b": np.concatenate([rng.integers(0, 10**10, 250), np.full(150, 5 * 10**9)])})
    got = matching.nearest_in_time(spark.createDataFrame(left), spark.createDataFrame(right), left_us="a", right_us="b", tolerance_us=30_000_000).toPandas().sort_values("v")
    gap = np.abs(left.a.to_numpy()[:, None] - right.b.to_numpy()[None])
    j = gap.argmin(1)
    ok = gap[np.arange(300), j] <= 30_000_000
    assert (got.seq.isna().to_numpy() == ~ok).all()
    assert (got.seq.to_numpy()[ok] == right.seq.to_numpy()[j][ok]).all()


def test_crossings_by_hand(spark):
    def track(tid, xs):
        return [(1, tid, i, "moto", float(x), 500.0, 0) for i, x in enumerate(xs)]

    rows = track(1, [100, 500, 900]) + track(2, [100, 900, 100, 900, 100]) + track(3, [460, 540, 470]) + track(4, [900, 500, 520, 900])
    df = spark.createDataFrame(rows, "video_id int, track_id int, frame int, cls string, cx double, cy double, sub int")
    got = {r.track_id: (r.forward, r.backward) for r in traffic.crossings(df, 1000.0, 1000.0).collect()}
    assert got == {1: (1, 0), 2: (1, 1)}
    video = spark.createDataFrame([(1, 30.0, 300)], "video_id int, duration_s double, n_frames int")
    counts = traffic.video_counts(df, video, 1000.0, 1000.0).first()
    assert (counts.moto_flow, counts.vehicles_flow, counts.line_axis, counts.n_tracks) == (6.0, 6.0, "x", 4)
    assert counts.moto_mean == pytest.approx(round(15 / 300, 2))


def test_gaps_are_filled_like_pandas(spark):
    have = {6: 10.0, 9: 40.0, 20: 7.0}
    df = spark.createDataFrame([("a", h, 2, v) for h, v in have.items()] + [("b", 12, 1, 3.0)], "site string, hour int, n_videos int, total double")
    got = traffic.fill_hours(df, ["total"]).toPandas()
    want = pd.Series(have).reindex(range(5, 22)).interpolate(limit_direction="both")
    a = got[got.site == "a"].sort_values("hour")
    assert np.allclose(a.total, want) and a.measured.sum() == 3 and (a[a.measured == 0].n_videos == 0).all()
    assert (got[got.site == "b"].total == 3.0).all()


def test_degree_raster_and_classes(spark):
    df = spark.createDataFrame([("a", 21.0, 105.0, 60.0), ("a", 21.0, 105.0001, 70.0), ("a", 21.01, 105.0, 50.0)], "site string, latitude double, longitude double, level_db double")
    got = describe.rasterise_degrees(df).toPandas()
    assert sorted(got.n) == [1, 2] and 65.0 in got.mean_value.tolist()


def test_littles_law_flags_overcounting(spark):
    df = spark.createDataFrame([(1.0, 60.0, 1.0), (2.0, 60.0, 2.2)], "vehicles_mean double, vehicles_flow double, dwell_s double")
    r = traffic.littles_law(df).first()
    assert r.implied_s == pytest.approx(1.5) and r.consistent
