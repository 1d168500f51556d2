"""Emission energies per vehicle class by non-negative least squares.

The data only enter as a Gram matrix of (sites + classes) columns, built in one
aggregation; the small system is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield.functions import levels
from soundfield.functions.numbers import correlation

CLASSES = ("moto", "car", "heavy")


def solve_nonnegative(gram: np.ndarray, moment: np.ndarray, max_rounds: int = 500) -> np.ndarray:
    """min |Ax - b|, x >= 0, from A'A and A'b (active set, columns scaled to unit norm)."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g, m = gram / np.outer(scale, scale), moment / scale
    n = len(m)
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    eps = 1e-12 * max(float(np.abs(m).max()), 1e-300)
    for _ in range(max_rounds):
        slope = m - g @ x
        wanted = np.where(~passive & (slope > eps))[0]
        if len(wanted) == 0:
            break
        passive[wanted[np.argmax(slope[wanted])]] = True
        while True:
            idx = np.where(passive)[0]
            z = np.zeros(n)
            z[idx] = np.linalg.lstsq(g[np.ix_(idx, idx)], m[idx], rcond=None)[0]
            low = idx[z[idx] <= 0]
            if len(low) == 0:
                x = z
                break
            room = x[low] / np.maximum(x[low] - z[low], 1e-300)
            x = x + room.min() * (z - x)
            passive[low[np.argmin(room)]] = False
            x[~passive] = 0.0
    return x / scale


def _design(sites: Sequence[str], suffix: str) -> dict[str, Column]:
    columns = {f"bg::{s}": (F.col("site") == s).cast("double") for s in sites}
    for c in CLASSES:
        columns[c] = F.col(f"{c}{suffix}").cast("double")
    return columns


def with_heavy(counts: DataFrame) -> DataFrame:
    return counts.withColumn("heavy_mean", F.col("bus_mean") + F.col("truck_mean")).withColumn(
        "heavy_flow", F.col("bus_flow") + F.col("truck_flow")
    )


def fit_emissions(counts: DataFrame, suffix: str = "_flow") -> tuple[DataFrame, DataFrame]:
    """(coefficients, fit): energies per site background and class; n, MAE, bias, r of the fit.

    `suffix` picks flow (energy per pass) or density (energy per vehicle in view).
    """
    spark = counts.sparkSession
    rows = counts.where(F.col("matched_db").isNotNull() & F.col("site").isNotNull())
    sites = sorted(r[0] for r in rows.select("site").distinct().collect())  # the study areas
    design = _design(sites, suffix)
    names, y = list(design), levels.to_energy(F.col("matched_db"))
    aggs = []
    for i, a in enumerate(names):
        aggs += [F.sum(design[a] * design[b]) for b in names[i:]] + [F.sum(design[a] * y)]
    sums = iter(rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(aggs)]).first())
    k = len(names)
    gram, moment = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = next(sums) or 0.0
        moment[i] = next(sums) or 0.0
    x = solve_nonnegative(gram, moment)
    predicted = sum((design[n] * float(v) for n, v in zip(names, x)), F.lit(0.0))
    p = levels.to_level_floored(predicted)
    fit = rows.withColumn("__p", p).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("__p") - F.col("matched_db"))).alias("mae_db"),
        F.avg(F.col("__p") - F.col("matched_db")).alias("bias_db"), correlation("__p", "matched_db").alias("r"),
    )
    coefficients = spark.createDataFrame(
        [(n, float(v), bool(v > 0)) for n, v in zip(names, x)], "category string, energy double, identifiable boolean"
    ).withColumn("level_db", levels.to_level(F.col("energy")))
    return coefficients, fit
