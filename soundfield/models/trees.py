"""Boosted trees and hybrids on MLlib.

Same role and features as the published models; MLlib grows trees level by
level, so numbers differ from leaf-wise libraries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions.numbers import rounded
from soundfield.models import kernel as K

# fixed values: the features of the published models
MORPHOLOGY = ["built_area_ratio", "road_density_km_km2", "intersection_count", "dist_road_m"]
MORPHOLOGY_SPLIT = ["built_area_ratio", "road_density_km_km2", "intersection_count", "dist_highway_m", "dist_residential_m"]
TIME = ["hour", "is_weekend"]
TIME_CYCLIC = ["hour_sin", "hour_cos", "is_weekend"]
RESTRICTED = ["built_area_ratio", "road_density_km_km2", "intersection_count", *TIME_CYCLIC]

FEATURE_SETS = {
    "trees_time": TIME,
    "trees_morphology": MORPHOLOGY,
    "trees_v1": MORPHOLOGY + TIME,
    "trees_v2": MORPHOLOGY_SPLIT + TIME_CYCLIC,
}


@dataclass(frozen=True)
class TreeSize:
    rounds: int = 300
    depth: int = 4
    step: float = 0.05
    rows_per_leaf: int = 10


FULL = TreeSize()
RESIDUAL = TreeSize(rounds=200, depth=3)
RESIDUAL_SMALL = TreeSize(rounds=120, depth=3)


def _known(features: Sequence[str]) -> Column:
    return F.forall(F.array(*[F.col(f).cast("double") for f in features]), lambda v: v.isNotNull() & ~F.isnan(v))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="error").transform(df)


def fit_trees(
    train: DataFrame, features: Sequence[str], label: str = "noise_db", size: TreeSize = FULL, *,
    validation: str | None = None, patience_tolerance: float = 0.01, seed: int = C.SEED,
) -> GBTRegressionModel:
    """Boosted regression trees on the rows that have all features; with a boolean validation column, boosting stops early on it."""
    early = {} if validation is None else {"validationIndicatorCol": validation, "validationTol": patience_tolerance}
    gbt = GBTRegressor(
        featuresCol="__features", labelCol=label, predictionCol="__p", maxIter=size.rounds, maxDepth=size.depth,
        stepSize=size.step, minInstancesPerNode=size.rows_per_leaf, seed=seed, **early,
    )
    return gbt.fit(_assembled(train.where(_known(features)), features))


def predict_trees(model: GBTRegressionModel, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Every row of `df` with the prediction; null where a feature is missing."""
    filled = df.withColumns({f"__{f}": F.when(_known(features), F.col(f)).otherwise(0) for f in features})
    found = model.transform(_assembled(filled, [f"__{f}" for f in features]))
    return found.withColumn(name, F.when(_known(features), F.col("__p"))).drop("__features", "__p", *[f"__{f}" for f in features])


def trees_by_fold(
    df: DataFrame, fold: str, folds: Sequence, features: Sequence[str], name: str, label: str = "noise_db", size: TreeSize = FULL
) -> DataFrame:
    """Out-of-fold predictions: one distributed fit per fold (folds are few)."""
    parts = []
    for f in folds:
        model = fit_trees(df.where(F.col(fold) != F.lit(f)), features, label, size)
        parts.append(predict_trees(model, df.where(F.col(fold) == F.lit(f)), features, name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hybrid_by_fold(
    df: DataFrame, fold: str, folds: Sequence, name: str = "hybrid", features: Sequence[str] | None = None, size: TreeSize = RESIDUAL
) -> DataFrame:
    """Kernel plus trees on its residual, both blind to the row's fold."""
    features = list(features or FEATURE_SETS["trees_v2"])
    kernels = K.fit_kernels(df, fold, folds)
    hw, res = F.col("dist_highway_m"), F.col("dist_residential_m")
    parts = []
    for f in folds:
        k = kernels[f]
        train = df.where(F.col(fold) != F.lit(f)).withColumn("__res", F.col("noise_db") - K.predict(k, hw, res))
        model = fit_trees(train, features, "__res", size)
        held = predict_trees(model, df.where(F.col(fold) == F.lit(f)), features, "__fix")
        parts.append(held.withColumn(name, K.predict(k, hw, res) + F.col("__fix")).drop("__fix"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def restricted_hybrid_by_fold(df: DataFrame, fold: str, folds: Sequence, size: TreeSize = RESIDUAL_SMALL) -> DataFrame:
    """The conservative hybrid: no distances in the residual, smaller trees."""
    return hybrid_by_fold(df, fold, folds, "hybrid_restricted", RESTRICTED, size)


@dataclass(frozen=True)
class Delivered:
    """The artefact: kernel, optional residual model, and what selected it."""

    kernel: K.Kernel
    residual: GBTRegressionModel | None
    features: tuple[str, ...]
    apply_residual: bool
    residual_sd_db: float
    model: str
    protocol: str


def final_fit(
    df: DataFrame, delivered: str, protocol: str, size: TreeSize | None = None, features: Sequence[str] | None = None
) -> Delivered:
    """Fit on all rows; the residual is applied only if a hybrid was selected.

    Features and size of the residual are those of the selected hybrid; without one, the full features and size.
    """
    chosen, rounds = {"hybrid": (FEATURE_SETS["trees_v2"], RESIDUAL), "hybrid_restricted": (RESTRICTED, RESIDUAL_SMALL)}.get(
        delivered, (FEATURE_SETS["trees_v2"], FULL)
    )
    features, size = list(features or chosen), size or rounds
    k = K.fit_kernels(df)[None]
    hw, res = F.col("dist_highway_m"), F.col("dist_residential_m")
    rows = df.withColumn("__res", F.col("noise_db") - K.predict(k, hw, res))
    apply_residual = delivered.startswith("hybrid")
    model = fit_trees(rows, features, "__res", size)
    sd = K.residual_sd(df, k).first()[0]
    return Delivered(k, model, tuple(features), apply_residual, float(sd), delivered, protocol)


def importances(artefact: Delivered) -> list[tuple[str, float]]:
    if artefact.residual is None:
        return []
    gains = artefact.residual.featureImportances.toArray()
    return sorted(zip(artefact.features, map(float, gains)), key=lambda t: -t[1])


def predict_grid(cells: DataFrame, artefact: Delivered, digits: int = 2) -> DataFrame:
    """Level of every grid row (features and hour columns present), kernel plus residual if flagged."""
    level = K.predict(artefact.kernel, F.col("dist_highway_m"), F.col("dist_residential_m"))
    if not artefact.apply_residual or artefact.residual is None:
        return cells.withColumn("level_db", rounded(level, digits))
    fixed = predict_trees(artefact.residual, cells, artefact.features, "__fix")
    return fixed.withColumn("level_db", rounded(level + F.col("__fix"), digits)).drop("__fix")
