"""Registry of models, out-of-fold evaluation under three protocols, and selection.

A model adds one column of predictions that have not seen the row's fold.
`buffered` is the form under buffered leave-one-out where it has a closed form;
models without one (trees) are left out of that protocol, since they would have
to be refitted once per row.  For a comparison of all models with a buffer there
is the protocol `buffered_folds`: one fit per block fold, without the rows within
the buffer of any held-out one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.models import baselines, folds, kernel, trees
from soundfield.models.features import with_block
from soundfield.operators import evaluation
from soundfield.operators.lattice import disc_sums
from soundfield.operators.scans import attach
from soundfield.session import cut_lineage

ByFold = Callable[[DataFrame, str, Sequence, str], DataFrame]
Buffered = Callable[[DataFrame, str], DataFrame]

BLOCK_CV, BUFFERED, BUFFERED_FOLDS, SITE_OUT = "block_cv", "buffered", "buffered_folds", "site_out"


@dataclass(frozen=True)
class Model:
    by_fold: ByFold
    buffered: Buffered | None = None


MODELS: dict[str, Model] = {}


def register(name: str, by_fold: ByFold, buffered: Buffered | None = None) -> None:
    """Add or replace a model: by_fold(rows, fold column, folds, name) -> rows plus column `name`."""
    MODELS[name] = Model(by_fold, buffered)


def _mean_by_fold(rows: DataFrame, fold: str, names: Sequence, name: str) -> DataFrame:
    table = baselines.fold_mean_table(rows, fold).withColumnRenamed("fold", "__f").select(
        "site", "hour", "__f", F.col(name).alias("__p")
    )
    return attach(rows.withColumn("__f", F.col(fold)), table, ["site", "hour", "__f"]).drop("__f").withColumnRenamed("__p", name)


def _mean_buffered(rows: DataFrame, name: str) -> DataFrame:
    base = rows.select("seq", "site", "hour", "x", "y", "noise_db")
    return rows.join(baselines.buffered_means(base).select("seq", name), "seq")


for _name in ("global_mean", "site_mean", "site_hour_mean"):
    register(_name, _mean_by_fold, _mean_buffered)

register(
    "dist_road",
    lambda rows, fold, names, name: baselines.fold_distance_line(rows, fold).withColumnRenamed("dist_road", name),
    lambda rows, name: baselines.buffered_distance_line(rows).withColumnRenamed("dist_road", name),
)
register(
    "idw",
    lambda rows, fold, names, name: baselines.inverse_distance(rows, fold=fold).withColumnRenamed("idw", name),
    lambda rows, name: baselines.inverse_distance(rows, buffer=C.BUFFER_M).withColumnRenamed("idw", name),
)
register(
    "kernel",
    lambda rows, fold, names, name: kernel.predict_by_fold(rows, kernel.fit_kernels(rows, fold, names), fold, name),
    lambda rows, name: kernel.buffered_kernel(rows, name=name),
)


def register_trees(full: trees.TreeSize = trees.FULL, residual: trees.TreeSize = trees.RESIDUAL, restricted: trees.TreeSize = trees.RESIDUAL_SMALL) -> None:
    """(Re)register the four tree models and the two hybrids with the given sizes."""
    for name, features in trees.FEATURE_SETS.items():
        register(name, lambda rows, fold, names, n, features=features: trees.trees_by_fold(rows, fold, names, features, n, size=full))
    register("hybrid", lambda rows, fold, names, n: trees.hybrid_by_fold(rows, fold, names, n, size=residual))
    register(
        "hybrid_restricted",
        lambda rows, fold, names, n: trees.hybrid_by_fold(rows, fold, names, n, trees.RESTRICTED, restricted),
    )


register_trees()


def buffered_by_fold(rows: DataFrame, folds_of: Sequence, by_fold: ByFold, name: str, radius: float = C.BUFFER_M) -> DataFrame:
    """(seq, name): predictions of each fold from the rows that lie outside the buffer of all its held-out rows.

    A fold whose buffer leaves no row to learn from has no predictions (nulls).
    """
    parts = []
    for f in folds_of:
        held = rows.where(F.col("fold") == F.lit(f))
        near = disc_sums(rows.where(F.col("fold") != F.lit(f)), held, radius, {"__held": F.lit(1)}).select("x", "y")
        train = rows.where(F.col("fold") != F.lit(f)).join(near, ["x", "y"], "left_anti")
        if train.isEmpty():
            parts.append(held.select("seq", F.lit(None).cast("double").alias(name)))
            continue
        both = held.withColumn("__side", F.lit("held")).unionByName(train.withColumn("__side", F.lit("train")))
        parts.append(by_fold(both, "__side", ["held"], name).where(F.col("__side") == "held").select("seq", name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predictions(features: DataFrame, protocol: str, models: Sequence[str] | None = None) -> DataFrame:
    """Long table protocol, model, seq, site, block_x, block_y, y, p.

    `features`: seq, site, hour, x, y, noise_db and the feature columns the models use.
    """
    rows = with_block(features)
    fold, names = "fold", []
    if protocol in (BLOCK_CV, BUFFERED_FOLDS):
        rows = folds.with_block_folds(rows)
    elif protocol == SITE_OUT:
        rows = rows.withColumn("fold", F.col("site"))
    rows = cut_lineage(rows)
    if protocol != BUFFERED:
        names = sorted(r[0] for r in rows.select("fold").distinct().collect())  # the block folds, or the sites
    long = None
    for name in models or list(MODELS):
        model = MODELS[name]
        if protocol == BUFFERED_FOLDS:
            found = buffered_by_fold(rows, names, model.by_fold, name)
        elif protocol == BUFFERED:
            if model.buffered is None:
                continue
            found = model.buffered(rows, name)
        else:
            found = model.by_fold(rows, fold, names, name)
        # three columns of each model are written, and every model starts from the same rows
        part = cut_lineage(found.select("seq", F.lit(name).alias("model"), F.col(name).alias("p")))
        long = part if long is None else long.unionByName(part)
    known = rows.select(F.lit(protocol).alias("protocol"), "seq", "site", "block_x", "block_y", F.col("noise_db").alias("y"))
    return known.join(long, "seq").select("protocol", "model", "seq", "site", "block_x", "block_y", "y", "p")


def evaluate(
    features: DataFrame, protocols: Sequence[str] = (BLOCK_CV, BUFFERED, BUFFERED_FOLDS, SITE_OUT), models: Sequence[str] | None = None, *, n_boot: int = C.N_BOOT
) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics): scores with block-bootstrap intervals of every model and protocol."""
    long = None
    for protocol in protocols:
        part = predictions(features, protocol, models)
        long = part if long is None else long.unionByName(part)
    long = cut_lineage(long)
    metrics = evaluation.scores(long).join(evaluation.bootstrap_intervals(long, n_boot=n_boot), ["protocol", "model"], "left")
    return long, cut_lineage(metrics)


# fixed values: the comparisons named before any score was seen
GAIN_PAIRS = (
    ("trees_v1", "site_hour_mean"), ("hybrid", "kernel"), ("hybrid", "dist_road"), ("hybrid", "trees_v1"),
)


def select_and_fit(
    features: DataFrame, metrics: DataFrame, protocol: str = BUFFERED_FOLDS, candidates: Sequence[str] = evaluation.DELIVERABLE
) -> trees.Delivered:
    """The candidate with the best R2 under the reference protocol, fitted on all rows; each must have a score."""
    scored = {r["model"] for r in metrics.where((F.col("protocol") == protocol) & F.col("r2").isNotNull()).select("model").collect()}
    if missing := [c for c in candidates if c not in scored]:
        raise ValueError(f"no score under {protocol} for {', '.join(missing)}")
    chosen = evaluation.delivered_model(metrics, protocol, candidates).first()["model"]
    return trees.final_fit(features, chosen, protocol)
