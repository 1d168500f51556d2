"""Radius and nearest searches against brute force, with crowded places."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundfield.operators import lattice


def crowded(seed=1, n=600):
    """A third of the points in one 60 m spot, a fifth exact copies, the rest spread out."""
    rng = np.random.default_rng(seed)
    spot = rng.uniform(0, 60, (n // 3, 2)) + 5000
    copies = np.tile([[5100.0, 5150.0]], (n // 5, 1))
    rest = rng.uniform(0, 9000, (n - n // 3 - n // 5, 2))
    xy = np.vstack([spot, copies, rest])
    return pd.DataFrame({"seq": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "v": rng.normal(65, 8, len(xy)), "fold": rng.integers(0, 3, len(xy))})


@pytest.fixture(scope="module")
def pdf():
    return crowded()


@pytest.fixture(scope="module")
def points(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def distances(a, b):
    return np.hypot(a.x.to_numpy()[:, None] - b.x.to_numpy()[None], a.y.to_numpy()[:, None] - b.y.to_numpy()[None])


@pytest.mark.parametrize("dense", [4096, 40])
@pytest.mark.parametrize("strict", [True, False])
def test_disc_sums(monkeypatch, points, pdf, dense, strict):
    monkeypatch.setattr(lattice, "DENSE_NEIGHBOURHOOD", dense)
    got = lattice.disc_sums(points, points, 300.0, {"n": F.lit(1).cast("bigint"), "s": F.col("v")}, strict=strict).toPandas()
    where = pdf[["x", "y"]].drop_duplicates().reset_index(drop=True)
    d = distances(where, pdf)
    inside = d < 300 if strict else d <= 300
    want = where.assign(n=inside.sum(1), s=inside @ pdf.v.to_numpy())
    both = want.merge(got, on=["x", "y"], suffixes=("", "_g"))
    assert len(both) == len(want) == len(got)
    assert (both.n == both.n_g).all()
    assert np.allclose(both.s, both.s_g)


def test_refinement_uses_several_depths(points):
    near = points.groupBy().agg(F.count(F.lit(1)).alias("n")).select(lattice._depth(F.col("n") * 100)).first()[0]
    assert near >= 3


def test_disc_sums_with_match(points, pdf):
    got = lattice.disc_sums(points, points, 300.0, {"n": F.lit(1).cast("bigint")}, match=["fold"]).toPandas()
    where = pdf[["fold", "x", "y"]].drop_duplicates().reset_index(drop=True)
    inside = (distances(where, pdf) < 300) & (where.fold.to_numpy()[:, None] == pdf.fold.to_numpy()[None])
    both = where.assign(n=inside.sum(1)).merge(got, on=["fold", "x", "y"])
    assert len(both) == len(where) and (both.n_x == both.n_y).all()


@pytest.mark.parametrize("mode", ["plain", "fold", "buffer"])
@pytest.mark.parametrize("leaf", [4, 32])
def test_nearest_points(points, pdf, mode, leaf):
    k = 5
    kwargs = {"plain": {}, "fold": {"fold": "fold"}, "buffer": {"buffer": 300.0}}[mode]
    got = lattice.nearest_points(points, points.select("x", "y", "seq", "fold"), k, leaf_targets=leaf, **kwargs).toPandas()
    keys = ["fold", "x", "y"] if mode == "fold" else ["x", "y"]
    where = pdf[keys].drop_duplicates().reset_index(drop=True)
    d = distances(where, pdf)
    if mode == "fold":
        d[where.fold.to_numpy()[:, None] == pdf.fold.to_numpy()[None]] = np.inf
    if mode == "buffer":
        d[d <= 300] = np.inf
    order = np.lexsort((np.broadcast_to(pdf.seq.to_numpy(), d.shape), d))[:, :k]
    want = where.loc[where.index.repeat(k)].reset_index(drop=True)
    want["rank"] = np.tile(range(1, k + 1), len(where))
    want["seq_w"] = pdf.seq.to_numpy()[order].ravel()
    want["d_w"] = np.take_along_axis(d, order, 1).ravel()
    both = want[np.isfinite(want.d_w)].merge(got, on=[*keys, "rank"], how="outer")
    assert both.seq.notna().all() and both.seq_w.notna().all()
    assert np.allclose(both.d, both.d_w)
    assert (both.seq == both.seq_w).all()


def _segment_distance(px, py, s):
    ux, uy = s.x2 - s.x1, s.y2 - s.y1
    norm = (ux * ux + uy * uy).to_numpy()
    t = ((px[:, None] - s.x1.to_numpy()) * ux.to_numpy() + (py[:, None] - s.y1.to_numpy()) * uy.to_numpy()) / np.where(norm > 0, norm, 1)
    t = np.clip(np.where(norm > 0, t, 0), 0, 1)
    return np.hypot(px[:, None] - s.x1.to_numpy() - t * ux.to_numpy(), py[:, None] - s.y1.to_numpy() - t * uy.to_numpy())


@pytest.fixture(scope="module")
def segments():
    rng = np.random.default_rng(5)
    start = np.vstack([rng.uniform(0, 9000, (60, 2)), rng.uniform(0, 40, (60, 2)) + 5000])
    end = start + np.vstack([rng.uniform(-900, 900, (60, 2)), rng.uniform(-20, 20, (60, 2))])
    end[0] = start[0]  # a segment of no length
    end[1, 0] = start[1, 0]  # a vertical one
    return pd.DataFrame({"x1": start[:, 0], "y1": start[:, 1], "x2": end[:, 0], "y2": end[:, 1], "kind": ["major", "minor"] * 60})


@pytest.mark.parametrize("leaf", [2, 32])
def test_nearest_segments(spark, points, pdf, segments, leaf):
    got = lattice.nearest_segments(points, spark.createDataFrame(segments), ["major", "minor", "absent"], leaf_targets=leaf).toPandas()
    where = pdf[["x", "y"]].drop_duplicates()
    assert set(got.kind) == {"major", "minor"}
    for kind, part in segments.groupby("kind"):
        d = _segment_distance(where.x.to_numpy(), where.y.to_numpy(), part).min(1)
        both = where.assign(w=d).merge(got[got.kind == kind], on=["x", "y"])
        assert len(both) == len(where)
        assert np.allclose(both.d, both.w)


def test_touching_length(spark, points, pdf, segments):
    from soundfield.operators.shapes import touching_length

    got = touching_length(points, spark.createDataFrame(segments), 300.0).toPandas()
    where = pdf[["x", "y"]].drop_duplicates()
    touch = _segment_distance(where.x.to_numpy(), where.y.to_numpy(), segments) <= 300
    length = np.hypot(segments.x2 - segments.x1, segments.y2 - segments.y1).to_numpy()
    both = where.assign(w=touch @ length).merge(got, on=["x", "y"], how="left").fillna({"length_m": 0.0})
    assert np.allclose(both.w, both.length_m)


def test_road_distance_is_the_least(spark, points, segments):
    from soundfield.models.features import road_distances

    only_minor = spark.createDataFrame(segments[segments.kind == "minor"])
    got = road_distances(points, only_minor).toPandas()
    assert (got.dist_highway_m == 2000.0).all()
    both = road_distances(points, spark.createDataFrame(segments)).toPandas()
    assert (both.dist_road_m <= both.dist_highway_m + 1e-9).all() and (both.dist_road_m <= both.dist_residential_m + 1e-9).all()


@pytest.mark.parametrize("n", [5, 400])
def test_noise_ceiling(spark, n):
    from soundfield.operators.evaluation import noise_ceiling

    rng = np.random.default_rng(n)
    rows = pd.DataFrame({
        "x": rng.integers(0, 120, n).astype(float), "y": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 120, n)).astype(float),
        "hour": rng.integers(8, 10, n), "noise_db": rng.integers(500, 520, n) / 10,
    })
    got = noise_ceiling(spark.createDataFrame(rows)).toPandas().set_index("band_m")
    i, j = np.triu_indices(n, 1)
    d = np.hypot(rows.x.to_numpy()[i] - rows.x.to_numpy()[j], rows.y.to_numpy()[i] - rows.y.to_numpy()[j])
    same = rows.hour.to_numpy()[i] == rows.hour.to_numpy()[j]
    diff = np.abs(rows.noise_db.to_numpy()[i] - rows.noise_db.to_numpy()[j])
    for band in (20.0, 40.0, 60.0):
        keep = same & (d < band)
        if keep.any():
            assert got.loc[band, "pairs"] == keep.sum()
            assert got.loc[band, "mean_abs_diff"] == pytest.approx(diff[keep].mean())


def test_growing_tables_are_never_broadcast(spark, monkeypatch):
    """Spark takes rows spread over cells for as small as the file they came from; merge joins do not trust that."""
    from soundfield.operators import lattice, polylines, shapes

    plans, real = [], lattice.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(lattice, "cut_lineage", noted)
    spots = spark.createDataFrame([(float(i * 7 % 90), float(i * 11 % 70), i) for i in range(60)], "x double, y double, seq long")
    pieces = spark.createDataFrame([("major", float(i), 0.0, float(i + 9), 50.0) for i in range(40)], "kind string, x1 double, y1 double, x2 double, y2 double")
    lines = pieces.selectExpr("array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2)) as line")
    made = [
        lattice.nearest_segments(spots, pieces, ["major", "minor"], leaf_targets=2), lattice.nearest_points(spots, spots, 3, leaf_targets=3),
        lattice.disc_sums(spots, spots, 20.0, {"n": F.lit(1)}), lattice.positions_near(spots, spots, 20.0),
        shapes.touching_length(spots, pieces, 20.0), polylines.touching_length(spots, lines, 20.0),
    ]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in made]
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_a_level_of_the_pyramid_halves_the_cells(spark):
    from soundfield.operators import lattice

    spots = spark.createDataFrame([(float(i), float(i * i % 97)) for i in range(200)], "x double, y double")
    sizes = lattice._pyramid_sizes(spots, spots, 4)
    assert len(sizes) > 3 and all(a == 2 * b for a, b in zip(sizes, sizes[1:]))


def test_noise_ceiling_lays_levels_out_once(spark):
    """Levels of neighbours go one way, in one shuffle that both the running sums and the chunk totals read."""
    from soundfield.operators.evaluation import noise_ceiling

    rng = np.random.default_rng(3)
    rows = [(int(h), float(x), float(y), float(v)) for h, x, y, v in zip(rng.integers(0, 2, 90), rng.integers(0, 60, 90), rng.integers(0, 60, 90), rng.integers(0, 9, 90) * 0.7)]
    got = noise_ceiling(spark.createDataFrame(rows, "hour int, x double, y double, noise_db double"))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in text and not any("x_r#" in line and "Window [" in line for line in text.splitlines())
    want = {b: [abs(p[3] - q[3]) for i, p in enumerate(rows) for q in rows[:i] if p[0] == q[0] and np.hypot(p[1] - q[1], p[2] - q[2]) < b] for b in (20.0, 40.0, 60.0)}
    found = {r.band_m: (r.pairs, r.mean_abs_diff) for r in got.collect()}
    assert {b: n for b, (n, _) in found.items()} == {b: len(d) for b, d in want.items()}
    assert all(abs(m - np.mean(want[b])) < 1e-9 for b, (_, m) in found.items())
