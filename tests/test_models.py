import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundfield.models import baselines, emissions, folds, kernel, trees
from soundfield.operators import evaluation


@pytest.fixture(scope="module")
def road_rows():
    rng = np.random.default_rng(3)
    n = 300
    d_hw, d_res = rng.uniform(1, 400, n), rng.uniform(1, 200, n)
    e = 4e7 / np.maximum(d_hw, 5) + 2e7 / np.maximum(d_res, 5)
    return pd.DataFrame({
        "seq": range(n), "x": rng.uniform(0, 3000, n), "y": rng.uniform(0, 3000, n), "site": rng.choice(["a", "b", "c"], n), "hour": rng.integers(6, 12, n),
        "noise_db": 10 * np.log10(e) + rng.normal(0, 4, n), "dist_highway_m": d_hw, "dist_residential_m": d_res, "dist_road_m": np.minimum(d_hw, d_res),
        "is_weekend": rng.integers(0, 2, n),
    })


def cost(p, r):
    e = p[0] / np.maximum(r.dist_highway_m, 5) + p[1] / np.maximum(r.dist_residential_m, 5) + p[2]
    return float(((10 * np.log10(np.maximum(e, 1e-9)) - r.noise_db) ** 2).sum())


def test_kernel_beats_random_search(spark, road_rows):
    df = spark.createDataFrame(road_rows)
    k = kernel.fit_kernels(df)[None]
    best = cost((k.a_hw, k.a_res, k.b), road_rows)
    assert best == pytest.approx(k.cost, rel=1e-9)
    assert min(k.a_hw, k.a_res, k.b) >= 0
    rng = np.random.default_rng(0)
    for p in 10 ** rng.uniform([6, 6, -2], [9, 9, 7], (4000, 3)):
        assert cost(p, road_rows) >= best * (1 - 1e-9)


def test_kernel_of_a_fold_has_not_seen_it(spark, road_rows):
    df = spark.createDataFrame(road_rows)
    fits = kernel.fit_kernels(df, "site", ["a", "b", "c"])
    alone = kernel.fit_kernels(df.where("site <> 'a'"))[None]
    assert fits["a"].cost == pytest.approx(alone.cost, rel=1e-6)
    held = kernel.predict_by_fold(df, fits, "site")
    assert held.where("kernel is null").count() == 0


def test_linearised_buffered_kernel_is_close_to_a_refit(spark, road_rows):
    df = spark.createDataFrame(road_rows)
    got = kernel.buffered_kernel(df).select("seq", "kernel").toPandas().set_index("seq").kernel
    for seq in (0, 57):
        r = road_rows.iloc[seq]
        far = road_rows[np.hypot(road_rows.x - r.x, road_rows.y - r.y) > 300]
        k = kernel.fit_kernels(spark.createDataFrame(far))[None]
        e = k.a_hw / max(r.dist_highway_m, 5) + k.a_res / max(r.dist_residential_m, 5) + k.b
        assert got[seq] == pytest.approx(10 * np.log10(e), abs=0.15)


def test_kernel_is_flat_inside_its_floor(spark):
    df = spark.createDataFrame([(1.0, 50.0), (5.0, 50.0), (6.0, 50.0)], "h double, r double")
    p = [r[0] for r in df.select(kernel.predict(kernel.published(), F.col("h"), F.col("r"))).collect()]
    assert p[0] == p[1] > p[2]


def test_nonnegative_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.normal(size=(30, 5)), rng.normal(size=30)
        x = emissions.solve_nonnegative(a.T @ a, a.T @ b)
        grad = a.T @ (a @ x - b)
        assert (x >= 0).all() and (grad[x == 0] >= -1e-8).all() and np.allclose(grad[x > 0], 0, atol=1e-8)


def test_emissions_recover_known_energies(spark):
    rng = np.random.default_rng(2)
    n = 200
    rows = pd.DataFrame({"site": rng.choice(["a", "b"], n), **{f"{c}_flow": rng.uniform(0, 20, n) for c in ("moto", "car", "bus", "truck")}, **{f"{c}_mean": 0.0 for c in ("bus", "truck")}})
    e = np.where(rows.site == "a", 1e6, 3e6) + 2e5 * rows.moto_flow + 5e5 * rows.car_flow
    rows["matched_db"] = 10 * np.log10(e)
    coefficients, fit = emissions.fit_emissions(emissions.with_heavy(spark.createDataFrame(rows)), "_flow")
    got = {r.category: r.energy for r in coefficients.collect()}
    assert got["bg::a"] == pytest.approx(1e6, rel=1e-3) and got["car"] == pytest.approx(5e5, rel=1e-3)
    assert got["heavy"] == pytest.approx(0, abs=10) and fit.first().mae_db < 1e-3


@pytest.mark.parametrize("seed", range(6))
def test_fold_runs_equal_plain_greedy(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [4, 30, 300, 5, 2, 60][seed], 200).tolist() + [[], [5000], [], [900, 900], [10**6], []][seed]
    k = 5
    load = [0] * k
    want = []
    for s in sorted(sizes, reverse=True):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += s
        want.append((s, f))
    values, counts = np.unique(sizes, return_counts=True)
    runs = folds._lightest_first(list(zip(values.tolist(), counts.tolist())), k)
    got = []
    for size, _, length, cycle in runs:
        got += [(size, cycle[i % len(cycle)]) for i in range(length)]
    assert got == want
    assert len(runs) < 60 * len(values) + 60


def test_hot_block_needs_few_runs():
    runs = folds._lightest_first([(10**12, 1), (1, 10**12)], 5)
    assert sum(r[2] for r in runs) == 10**12 + 1 and len(runs) < 50


def test_exclusion_radius(spark, road_rows):
    """A buffer leaves out every near row, a smaller one leaks."""
    df = spark.createDataFrame(road_rows)
    n = {b: baselines.buffered_means(df, b).agg(F.sum("n_train")).first()[0] for b in (110.0, 300.0)}
    d = np.hypot(road_rows.x.to_numpy()[:, None] - road_rows.x.to_numpy(), road_rows.y.to_numpy()[:, None] - road_rows.y.to_numpy())
    assert n[300.0] == (d > 300).sum() and n[110.0] == (d > 110).sum() and n[110.0] > n[300.0]


def test_too_small_training_sets_give_nothing(spark, road_rows):
    df = spark.createDataFrame(road_rows.head(15))
    assert baselines.buffered_means(df).where("global_mean is not null").count() == 0


def test_scores_ignore_missing_and_constant(spark):
    df = spark.createDataFrame([("p", "m", 1.0, 2.0), ("p", "m", 3.0, 2.0), ("p", "m", 9.0, None)], "protocol string, model string, y double, p double")
    r = evaluation.scores(df).first()
    assert (r.n, r.r, r.r2, r.mae) == (2, None, 0.0, 1.0)


def test_ranking_and_gains(spark):
    df = spark.createDataFrame([("a", "kernel", 0.3, 5.0), ("a", "dist_road", 0.3, 5.5), ("b", "kernel", 0.1, 5.0), ("b", "dist_road", 0.2, 4.0)],
                               "protocol string, model string, r2 double, mae double")
    assert evaluation.delivered_model(df, "a").first().model == "dist_road"
    shift = {r.model: r.shift for r in evaluation.rank_shift(df, "a", "b").collect()}
    assert shift == {"kernel": 1, "dist_road": 0}
    gain = {r.protocol: r for r in evaluation.paired_gains(df, [("kernel", "dist_road")]).collect()}
    assert gain["a"].gain_mae_db == pytest.approx(0.5) and gain["b"].gain_r2 == pytest.approx(-0.1)


def test_trees_are_repeatable_and_stop_early(spark, road_rows, tmp_path):
    rows = road_rows.assign(hour_sin=np.sin(road_rows.hour), hour_cos=np.cos(road_rows.hour), built_area_ratio=0.1, road_density_km_km2=5.0, intersection_count=3)
    df = spark.createDataFrame(rows)
    size = trees.TreeSize(rounds=6, depth=3, step=0.3)
    a, b = (trees.trees_by_fold(df, "site", ["a", "b", "c"], trees.FEATURE_SETS["trees_v2"], "p", size=size).orderBy("seq").toPandas().p for _ in range(2))
    assert np.allclose(a, b)
    split = df.withColumn("held", F.col("seq") % 4 == 0)
    stopped = trees.fit_trees(split, ["hour"], size=trees.TreeSize(rounds=40, depth=2, step=0.3), validation="held")
    assert stopped.getNumTrees < 40
    from soundfield.sources.writers import read_kernel, write_kernel

    for model in ("kernel", "hybrid"):
        artefact = trees.final_fit(df, model, "bloo", size)
        assert artefact.apply_residual == (model == "hybrid") and artefact.residual_sd_db > 0
        assert len(trees.importances(artefact)) == len(artefact.features)
        write_kernel(spark, artefact, str(tmp_path / model))
        back = read_kernel(spark, str(tmp_path / model))
        x = trees.predict_grid(df, artefact).orderBy("seq").toPandas().level_db
        y = trees.predict_grid(df, back).orderBy("seq").toPandas().level_db
        assert np.allclose(x, y)


def test_selected_restricted_hybrid_is_delivered_with_its_own_features(spark, road_rows, monkeypatch):
    rows = road_rows.assign(hour_sin=0.0, hour_cos=1.0, built_area_ratio=0.1, road_density_km_km2=5.0, intersection_count=3)
    tiny = trees.TreeSize(rounds=2, depth=2, step=0.3)
    monkeypatch.setattr(trees, "RESIDUAL_SMALL", tiny)
    artefact = trees.final_fit(spark.createDataFrame(rows), "hybrid_restricted", "buffered_folds")
    assert artefact.features == tuple(trees.RESTRICTED) and artefact.residual.getNumTrees == 2 and artefact.apply_residual


def test_hybrids(spark, road_rows):
    rows = road_rows.assign(hour_sin=0.0, hour_cos=1.0, built_area_ratio=0.1, road_density_km_km2=5.0, intersection_count=3)
    df = spark.createDataFrame(rows)
    size = trees.TreeSize(rounds=3, depth=2, step=0.3)
    got = trees.hybrid_by_fold(df, "site", ["a", "b", "c"], size=size)
    assert got.where("hybrid is not null").count() == len(rows)
    assert trees.restricted_hybrid_by_fold(df, "site", ["a", "b", "c"], size).count() == len(rows)
