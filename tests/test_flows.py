"""The jobs end to end on a small town."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundfield import flows
from soundfield.functions import geo
from soundfield.models import selection, trees
from soundfield.operators import energy


@pytest.fixture(scope="module")
def town(spark):
    rng = np.random.default_rng(11)
    n = 240
    site = rng.integers(0, 3, n)
    pts = pd.DataFrame({
        "seq": range(n), "site": [f"s{i}" for i in site], "x": 580000 + site * 4000 + rng.integers(0, 1200, n), "y": 2320000.0 + rng.integers(0, 1200, n),
        "hour": rng.integers(6, 21, n), "is_weekend": rng.integers(0, 2, n), "noise_db": np.round(rng.normal(68, 5, n), 1),
    }).astype({"x": float})
    k = 150
    rs = rng.integers(0, 3, k)
    x1, y1 = 580000 + rs * 4000 + rng.uniform(0, 1200, k), 2320000 + rng.uniform(0, 1200, k)
    roads = pd.DataFrame({"x1": x1, "y1": y1, "x2": x1 + rng.uniform(-200, 200, k), "y2": y1 + rng.uniform(-200, 200, k), "kind": rng.choice(["major", "minor"], k)})
    spots = pd.DataFrame({"x": x1 + 5, "y": y1 + 5, "area_m2": rng.uniform(50, 300, k)})
    return [spark.createDataFrame(f) for f in (pts, spots, spots.drop(columns="area_m2"), roads)]


def test_evaluate_select_publish(spark, town, tmp_path, monkeypatch):
    points, buildings, nodes, roads = town
    rows = flows.build_features(points, buildings, nodes, roads).cache()
    assert rows.where("built_area_ratio < 0 or built_area_ratio > 1 or dist_road_m > dist_highway_m + 1e-9").count() == 0
    tiny = trees.TreeSize(rounds=2, depth=2, step=0.3)
    monkeypatch.setattr(trees, "RESIDUAL", tiny)
    monkeypatch.setattr(trees, "FULL", tiny)
    before = dict(selection.MODELS)
    selection.register_trees(tiny, tiny, tiny)
    try:
        models = ["global_mean", "site_hour_mean", "dist_road", "idw", "trees_v1", "kernel", "hybrid"]
        predictions, metrics = selection.evaluate(rows, ("block_cv", "buffered", "site_out"), models, n_boot=50)
        table = metrics.toPandas()
    finally:
        selection.MODELS.update(before)
    got = table.groupby("protocol").model.apply(set).to_dict()
    assert got["block_cv"] == got["site_out"] == set(models)
    assert got["buffered"] == {"global_mean", "site_hour_mean", "dist_road", "idw", "kernel"}
    assert (table.n == 240).all() and (table.r2_lo <= table.r2_hi).all() and (table.mae_lo <= table.mae_hi).all()
    assert predictions.count() == 240 * (7 + 7 + 5)
    artefact = flows.evaluate_and_select(rows, str(tmp_path / "eval"), protocols=["buffered"], models=["dist_road", "kernel"], n_boot=20)
    assert spark.read.json(str(tmp_path / "eval/metrics")).count() == 2
    grid_rows = flows.publish_map(points, buildings, nodes, roads, artefact, str(tmp_path / "map"))
    wide = spark.read.option("header", True).csv(str(tmp_path / "map/wide"))
    assert wide.count() * 17 == grid_rows.count()


def test_buffered_folds_score_every_candidate_without_near_rows(spark):
    rng = np.random.default_rng(5)
    n = 90
    rows = pd.DataFrame({
        "seq": range(n), "site": rng.choice(["a", "b"], n), "x": rng.uniform(0, 60000, n), "y": rng.uniform(0, 60000, n), "hour": rng.integers(6, 12, n),
        "noise_db": rng.normal(65, 4, n), "hour_sin": 0.1, "hour_cos": 0.2, "is_weekend": 0, "built_area_ratio": rng.random(n), "road_density_km_km2": rng.random(n),
        "intersection_count": rng.integers(0, 9, n), "dist_road_m": rng.uniform(1, 90, n), "dist_highway_m": rng.uniform(1, 900, n), "dist_residential_m": rng.uniform(1, 90, n),
    })
    rows.loc[10, "built_area_ratio"] = None
    rows.loc[11, ["x", "y"]] = rows.loc[12, ["x", "y"]].values + 100
    df = spark.createDataFrame(rows).withColumn("built_area_ratio", F.nanvl("built_area_ratio", F.lit(None).cast("double")))
    seen = []
    selection.register("spy", lambda r, fold, names, name: (seen.append(r.select("seq", fold).toPandas()), r.withColumn(name, F.lit(60.0)))[1])
    before = dict(selection.MODELS)
    selection.register_trees(*[trees.TreeSize(rounds=1, depth=2, step=0.3, rows_per_leaf=3)] * 3)
    try:
        got = selection.predictions(df, selection.BUFFERED_FOLDS, ["trees_v1", "spy", "hybrid_restricted"]).toPandas()
    finally:
        selection.MODELS.update(before)
        del selection.MODELS["spy"]
    assert (got.groupby("model").size() == n).all()
    missing = got[got.p.isna()].groupby("model").seq.apply(set).to_dict()
    assert missing == {"trees_v1": {10}, "hybrid_restricted": {10}}
    assert sum(len(s[s.__side == "held"]) for s in seen) == n
    for s in seen:
        held, train = (rows[rows.seq.isin(s.seq[s.__side == side])] for side in ("held", "train"))
        apart = np.hypot(held.x.values[:, None] - train.x.values, held.y.values[:, None] - train.y.values)
        assert len(train) and apart.min() >= 300


def test_selection_needs_a_score_of_every_candidate(spark):
    metrics = spark.createDataFrame([("buffered_folds", "kernel", 0.3)], "protocol string, model string, r2 double")
    with pytest.raises(ValueError, match="no score under buffered_folds for dist_road"):
        selection.select_and_fit(metrics, metrics)


def test_unknown_models_can_be_registered(town):
    points = town[0]
    selection.register("constant", lambda rows, fold, names, name: rows.withColumn(name, F.lit(60.0)))
    try:
        got = selection.predictions(points, "site_out", ["constant"])
        assert got.select("p").distinct().count() == 1
    finally:
        del selection.MODELS["constant"]


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/export_1.csv").write_text(
        "start;collector;_latitude;_longitude;_precision;noise_db;noise_class;site\n2026-06-22T06:27:00+07:00;a;21.0317;105.8514;5;70;Transportation noise;Ocean Park\n")
    hour = spark.sql("select timestamp_ntz'2026-06-22 06:00:00' as time_h, 'Hoan Kiem lake' as site, 30.0D as temperature_2m, 1.0D as wind_speed_10m, 0.0D as precipitation")
    rows = flows.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), weather=hour)
    r = flows.located(rows).first()
    assert r.temperature_2m == 30.0 and 587000 < r.x < 590000
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_emission_table(spark):
    coefficients = spark.createDataFrame([("bg::a", 1.0, True, 0.0), ("moto", 0.0, False, None)], "category string, energy double, identifiable boolean, level_db double")
    rows = spark.createDataFrame([(70.0, True), (60.0, False)], "noise_db double, near boolean")
    got = {r.category: r for r in energy.emission_table(coefficients, energy.construction_source(rows, F.col("near"))).collect()}
    assert set(got) == {"moto", "construction"} and got["construction"].level_db == pytest.approx(10 * np.log10(1e7 - 1e6))
