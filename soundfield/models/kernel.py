"""Physical kernel: E = A_hw / max(d_hw, D0) + A_res / max(d_res, D0) + B, fitted in decibels.

Each Gauss-Newton step is one aggregation of nine sums per fold over the
feature table; the driver solves 3 x 3 systems.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.operators.quantiles import grouped_quantiles
from soundfield.operators.scans import with_scalars

_TEN_OVER_LN10 = 10.0 / math.log(10.0)


@dataclass(frozen=True)
class Kernel:
    a_hw: float
    a_res: float
    b: float
    cost: float = float("nan")
    iterations: int = 0
    floor_m: float = C.KERNEL_FLOOR_M


def energy(kernel: Kernel, d_hw: Column, d_res: Column) -> Column:
    near = F.lit(kernel.floor_m)
    return kernel.a_hw / F.greatest(d_hw, near) + kernel.a_res / F.greatest(d_res, near) + kernel.b


def predict(kernel: Kernel, d_hw: Column, d_res: Column) -> Column:
    return 10.0 * F.log10(F.greatest(energy(kernel, d_hw, d_res), F.lit(1e-9)))


def published() -> Kernel:
    return Kernel(**C.PUBLISHED_KERNEL)


def start_point(df: DataFrame) -> np.ndarray:
    """Half of the mean energy to the background, a quarter to each road class at its median distance."""
    floor = F.lit(C.KERNEL_FLOOR_M)
    e = df.agg(F.avg(F.pow(F.lit(10.0), F.col("noise_db") / 10.0))).first()[0]
    long = df.select(F.explode(F.array(
        F.struct(F.lit("hw").alias("k"), F.greatest("dist_highway_m", floor).alias("d")),
        F.struct(F.lit("res").alias("k"), F.greatest("dist_residential_m", floor).alias("d")),
    )).alias("s")).select("s.k", "s.d")
    med = {r["k"]: r["m"] for r in grouped_quantiles(long, ["k"], F.col("d"), {"m": 0.5}).collect()}
    return np.array([0.25 * e * med["hw"], 0.25 * e * med["res"], 0.5 * e])


def _sums(at: int, train: Column) -> list[Column]:
    """Normal-equation sums of one fold; its parameters are entries at, at+1, at+2 of column `params`."""
    floor = F.lit(C.KERNEL_FLOOR_M)
    p = [F.get("params", F.lit(at + i)) for i in range(3)]
    base = (1.0 / F.greatest("dist_highway_m", floor), 1.0 / F.greatest("dist_residential_m", floor), F.lit(1.0))
    e = F.greatest(base[0] * p[0] + base[1] * p[1] + p[2], F.lit(1e-9))
    r = 10.0 * F.log10(e) - F.col("noise_db")
    g = [b * _TEN_OVER_LN10 / e for b in base]
    terms = [g[i] * g[j] for i in range(3) for j in range(i, 3)] + [x * r for x in g] + [r * r]
    return [F.sum(F.when(train, t)) for t in terms]


def fit_kernels(
    df: DataFrame, fold: str | None = None, folds: Sequence = (), *, tolerance: float = 1e-10, max_rounds: int = 80
) -> dict:
    """Kernel per fold, trained on the rows of the other folds; key None without folds.

    Damped Gauss-Newton in parameters scaled by the start point.  A parameter at
    zero whose gradient points down stays there.  All folds share each pass.
    """
    data = df.select("noise_db", "dist_highway_m", "dist_residential_m", *([fold] if fold else [])).dropna().withColumn("one", F.lit(1)).persist()
    names = list(folds) if fold else [None]
    train = {f: (F.col(fold) != F.lit(f)) if fold else F.lit(True) for f in names}
    p0 = start_point(data)

    columns = [c.alias(f"c{i}") for i, c in enumerate(c for k, f in enumerate(names) for c in _sums(3 * k, train[f]))]

    def evaluate(points: Mapping) -> dict:
        # parameters come in as a one-row table: the compiled plan is the same at every step
        flat = [float(v) for f in names for v in points.get(f, p0)]
        given = df.sparkSession.createDataFrame([(1, flat)], "one int, params array<double>")
        row = data.join(F.broadcast(given), "one").agg(*columns).first()
        out = {}
        for k, f in enumerate(names):
            v = [row[10 * k + i] for i in range(10)]
            if f not in points or any(x is None for x in v):
                continue
            jtj = np.array([[v[0], v[1], v[2]], [v[1], v[3], v[4]], [v[2], v[4], v[5]]])
            out[f] = (jtj * np.outer(p0, p0), np.array(v[6:9]) * p0, v[9])
        return out

    state = {}
    for f, (jtj, g, cost) in evaluate({f: p0 for f in names}).items():
        state[f] = {"q": np.ones(3), "jtj": jtj, "g": g, "cost": cost, "damp": 1e-3, "done": False, "rounds": 0}
    for _ in range(max_rounds):
        trial = {}
        for f, s in state.items():
            if s["done"]:
                continue
            free = ~((s["q"] <= 0) & (s["g"] > 0))
            if not free.any():
                s["done"] = True
                continue
            h = s["jtj"][np.ix_(free, free)]
            h = h + s["damp"] * np.diag(np.maximum(np.diag(h), 1e-12))
            step = np.zeros(3)
            step[free] = -np.linalg.solve(h, s["g"][free])
            s["next"] = np.maximum(s["q"] + step, 0.0)
            trial[f] = s["next"] * p0
        if not trial:
            break
        for f, (jtj, g, cost) in evaluate(trial).items():
            s = state[f]
            s["rounds"] += 1
            if cost <= s["cost"]:
                gain = (s["cost"] - cost) / max(s["cost"], 1e-300)
                s.update(q=s["next"], jtj=jtj, g=g, cost=cost, damp=max(s["damp"] / 5, 1e-12))
                s["done"] = gain < tolerance
            else:
                s["damp"] *= 5
                s["done"] = s["damp"] > 1e12
    data.unpersist()
    return {f: Kernel(*(float(v) for v in s["q"] * p0), cost=float(s["cost"]), iterations=s["rounds"]) for f, s in state.items()}


def predict_by_fold(df: DataFrame, kernels: Mapping, fold: str, name: str = "kernel") -> DataFrame:
    """Adds each row's prediction by the kernel that has not seen its fold; folds are few."""
    expr = F.lit(None).cast("double")
    for f, k in kernels.items():
        expr = F.when(F.col(fold) == F.lit(f), predict(k, F.col("dist_highway_m"), F.col("dist_residential_m"))).otherwise(expr)
    return df.withColumn(name, expr)


def buffered_kernel(df: DataFrame, buffer: float = C.BUFFER_M, at_least: int = C.MIN_TRAINING_ROWS, name: str = "kernel") -> DataFrame:
    """Buffered leave-one-out of the kernel, linearised at the fit on all rows.

    The normal equations of the full fit, minus the terms of the rows inside the
    buffer (a disc sum), give each held-out row its own parameters: one
    Gauss-Newton step, solved in columns by Cramer's rule.  Refitting to
    convergence per row would need all rows once per row.  Parameters are kept
    non-negative by clipping the step.
    """
    from soundfield.operators.lattice import disc_sums

    full = fit_kernels(df)[None]
    p = [full.a_hw, full.a_res, full.b]
    free = [i for i in range(3) if p[i] > 0] or [0]
    floor = F.lit(full.floor_m)
    base = (1.0 / F.greatest("dist_highway_m", floor), 1.0 / F.greatest("dist_residential_m", floor), F.lit(1.0))
    e = F.greatest(energy(full, F.col("dist_highway_m"), F.col("dist_residential_m")), F.lit(1e-9))
    r = 10.0 * F.log10(e) - F.col("noise_db")
    # columns scaled by their own parameter: relative steps
    g = {i: base[i] * (_TEN_OVER_LN10 * p[i]) / e for i in free}
    terms = {"n": F.lit(1.0)}
    for a in free:
        terms[f"g{a}"] = g[a] * r
        for b in free:
            if b >= a:
                terms[f"h{a}{b}"] = g[a] * g[b]
    total = df.agg(*[F.sum(t).alias(f"t_{k}") for k, t in terms.items()])
    inside = disc_sums(df, df, buffer, terms, strict=False).select("x", "y", *[F.col(k).alias(f"e_{k}") for k in terms])
    rows = with_scalars(df, total)
    rows = rows.join(inside, ["x", "y"], "left")
    left = {k: F.col(f"t_{k}") - F.coalesce(F.col(f"e_{k}"), F.lit(0.0)) for k in terms}

    def h(a: int, b: int) -> Column:
        return left[f"h{min(a, b)}{max(a, b)}"]

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return sum(
            ((-1) ** c) * m[0][c] * det([[row[d] for d in range(3) if d != c] for row in m[1:]]) for c in range(3)
        )

    matrix = [[h(a, b) for b in free] for a in free]
    whole = det(matrix)
    moved = {}
    for c, i in enumerate(free):
        swapped = [[(-left[f"g{free[rr]}"] if cc == c else matrix[rr][cc]) for cc in range(len(free))] for rr in range(len(free))]
        moved[i] = F.greatest(p[i] * (1.0 + det(swapped) / F.when(whole != 0, whole)), F.lit(0.0))
    energy_i = sum((moved[i] * base[i] for i in free), F.lit(0.0))
    level = 10.0 * F.log10(F.greatest(energy_i, F.lit(1e-9)))
    return rows.withColumn(name, F.when(left["n"] >= at_least, level)).select(*df.columns, name)


def residual_sd(df: DataFrame, kernel: Kernel) -> DataFrame:
    """Population sd of the in-sample residual."""
    p = predict(kernel, F.col("dist_highway_m"), F.col("dist_residential_m"))
    return df.agg(F.stddev_pop(F.col("noise_db") - p).alias("residual_sd_db"))
