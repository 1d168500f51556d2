"""Closed-form models whose out-of-fold predictions come from sums, not from refits.

For every protocol the training sums of a row are total sums minus the sums of
the rows it must not see: its own fold, or the disc around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.models.features import log_distance
from soundfield.operators.lattice import disc_sums, nearest_points
from soundfield.operators.scans import attach, with_scalars


def fold_mean_table(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Predictions of the three mean models for every (site, hour, fold) that occurs.

    One aggregation of the data to (site, hour, fold); the rest happens on that
    small table.  A missing mean falls back: (site, hour), site, all.
    """
    g = df.groupBy("site", "hour", F.col(fold).alias("fold")).agg(F.sum("noise_db").alias("s"), F.count("noise_db").alias("n"))

    def over(*keys):
        return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))

    def rest(c, all_keys, own_keys):
        return F.sum(c).over(over(*all_keys)) - F.sum(c).over(over(*own_keys))

    def mean(all_keys, own_keys):
        n = rest("n", all_keys, own_keys)
        return F.when(n > 0, rest("s", all_keys, own_keys) / F.when(n > 0, n))

    t = g.select(
        "site", "hour", "fold", mean([], ["fold"]).alias("a"), mean(["site"], ["site", "fold"]).alias("b"),
        mean(["site", "hour"], ["site", "hour", "fold"]).alias("c"),
    )
    return t.select(
        "site", "hour", "fold", F.col("a").alias("global_mean"), F.coalesce("b", "a").alias("site_mean"),
        F.coalesce("c", "b", "a").alias("site_hour_mean"),
    )


def fold_means(df: DataFrame, fold: str = "fold") -> DataFrame:
    return attach(df, fold_mean_table(df, fold).withColumnRenamed("fold", fold), ["site", "hour", fold])


def buffered_means(df: DataFrame, buffer: float = C.BUFFER_M, at_least: int = C.MIN_TRAINING_ROWS) -> DataFrame:
    """Mean models under buffered leave-one-out, exact: totals minus the rows within the buffer."""
    sums = {"s": F.col("noise_db"), "n": F.lit(1).cast("bigint")}
    out = df
    names = {0: "a", 1: "b", 2: "c"}
    for i, keys in enumerate(([], ["site"], ["site", "hour"])):
        inside = disc_sums(df, df, buffer, sums, strict=False, match=keys).select(
            *keys, "x", "y", F.col("s").alias(f"s_in{i}"), F.col("n").alias(f"n_in{i}")
        )
        if keys:
            total = df.groupBy(*keys).agg(F.sum("noise_db").alias(f"s_all{i}"), F.count(F.lit(1)).alias(f"n_all{i}"))
            out = attach(out, total, keys)
            out = out.join(inside, [*keys, "x", "y"], "left")
        else:
            total = df.agg(F.sum("noise_db").alias(f"s_all{i}"), F.count(F.lit(1)).alias(f"n_all{i}"))
            out = with_scalars(out, total)
            out = out.join(inside, ["x", "y"], "left")
        n = F.col(f"n_all{i}") - F.col(f"n_in{i}")
        out = out.withColumn(names[i], F.when(n > 0, (F.col(f"s_all{i}") - F.col(f"s_in{i}")) / F.when(n > 0, n)))
        if i == 0:
            out = out.withColumn("n_train", n)
        out = out.drop(f"n_all{i}", f"n_in{i}", f"s_all{i}", f"s_in{i}")
    enough = F.col("n_train") >= at_least
    return out.select(
        *df.columns, "n_train", F.when(enough, F.col("a")).alias("global_mean"),
        F.when(enough, F.coalesce("b", "a")).alias("site_mean"),
        F.when(enough, F.coalesce("c", "b", "a")).alias("site_hour_mean"),
    )


_LINE = ("n", "sx", "sy", "sxx", "sxy")


def _centred(df: DataFrame) -> DataFrame:
    """Adds lx, ly: log distance and level, both minus their means, so differences keep their digits."""
    means = df.agg(F.avg(log_distance(F.col("dist_road_m"))).alias("__mx"), F.avg("noise_db").alias("__my"))
    joined = with_scalars(df, means)
    return joined.withColumn("lx", log_distance(F.col("dist_road_m")) - F.col("__mx")).withColumn("ly", F.col("noise_db") - F.col("__my"))


def _line_sums():
    x, y = F.col("lx"), F.col("ly")
    return {"n": F.lit(1).cast("double"), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}


def _line_prediction(rows: DataFrame, at_least: int = 2) -> DataFrame:
    """p from total minus excluded sums (columns t_* and e_*), at lx."""
    v = {k: F.col(f"t_{k}") - F.coalesce(F.col(f"e_{k}"), F.lit(0.0)) for k in _LINE}
    det = v["n"] * v["sxx"] - v["sx"] * v["sx"]
    slope = (v["n"] * v["sxy"] - v["sx"] * v["sy"]) / F.when(det > 0, det)
    intercept = (v["sy"] - slope * v["sx"]) / F.when(v["n"] > 0, v["n"])
    p = slope * F.col("lx") + intercept + F.col("__my")
    return rows.withColumn("dist_road", F.when(v["n"] >= at_least, p)).drop(
        *[f"{s}_{k}" for s in "te" for k in _LINE], "lx", "ly", "__mx", "__my"
    )


def _with_totals(rows: DataFrame) -> DataFrame:
    total = rows.agg(*[F.sum(e).alias(f"t_{k}") for k, e in _line_sums().items()])
    return with_scalars(rows, total)


def fold_distance_line(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Adds dist_road: level regressed on log distance to the road, own fold left out."""
    rows = _centred(df)
    own = rows.groupBy(fold).agg(*[F.sum(e).alias(f"e_{k}") for k, e in _line_sums().items()])
    return _line_prediction(attach(_with_totals(rows), own, [fold]))


def buffered_distance_line(df: DataFrame, buffer: float = C.BUFFER_M, at_least: int = C.MIN_TRAINING_ROWS) -> DataFrame:
    rows = _centred(df)
    inside = disc_sums(rows, rows, buffer, _line_sums(), strict=False)
    inside = inside.select("x", "y", *[F.col(k).alias(f"e_{k}") for k in _LINE])
    return _line_prediction(_with_totals(rows).join(inside, ["x", "y"], "left"), at_least)


def log1p_fit(df: DataFrame) -> DataFrame:
    """In-sample line of level on log(1 + distance)."""
    x = F.log1p(F.greatest(F.col("dist_road_m"), F.lit(0.0)))
    fit = df.withColumn("__x", x)
    return fit.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("noise_db", "__x").alias("slope"),
        F.regr_intercept("noise_db", "__x").alias("intercept"), F.regr_r2("noise_db", "__x").alias("r2"),
    )


def inverse_distance(
    df: DataFrame, *, fold: str | None = None, buffer: float | None = None, k: int = 8, power: float = 2.0, tie: str = "seq"
) -> DataFrame:
    """Adds idw: weighted mean of the k nearest rows of other folds, or beyond the buffer."""
    points = df.select("x", "y", tie, "noise_db", *([fold] if fold else []))
    near = nearest_points(df, points, k, fold=fold, buffer=buffer, tie=tie)
    if fold:
        near = near.withColumnRenamed("fold", fold)
    keys: Sequence[str] = [fold, "x", "y"] if fold else ["x", "y"]
    w = 1.0 / F.pow(F.greatest(F.col("d"), F.lit(1e-6)), power)
    blended = near.groupBy(*keys).agg((F.sum(w * F.col("noise_db")) / F.sum(w)).alias("idw"))
    return df.join(blended, list(keys), "left")
