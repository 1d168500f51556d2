"""Writers of published tables, maps and small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.operators.cleaning import published
from soundfield.operators.grid import wide_map


def write_measurements(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Published columns only; collectors, contributors and notes are never written."""
    rows = published(df)
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_noise_map(grid: DataFrame, path: str, reference_hour: int = C.REFERENCE_HOUR) -> None:
    """`grid`: site, ix, iy, longitude, latitude, hour, level_db.

    Writes the wide map (h5 .. h21), split by site so a reader of one site reads
    only its files, and the flat map of the reference hour.
    """
    placed = grid.withColumn("longitude", F.round("longitude", 7)).withColumn("latitude", F.round("latitude", 7))
    wide = wide_map(placed, ["site", "longitude", "latitude"])
    wide.write.mode("overwrite").partitionBy("site").option("header", True).csv(f"{path}/wide")
    flat = placed.where(F.col("hour") == reference_hour).select(
        F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.col("level_db").alias("noise_db"), "site", "hour"
    )
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/flat")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Small result tables (fleet, exceedances, anchors, metrics)."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))


def write_kernel(df_session, artefact, path: str) -> None:
    """Parameters of the delivered model as one JSON row; the residual model next to it."""
    k = artefact.kernel
    row = (k.a_hw, k.a_res, k.b, k.floor_m, artefact.apply_residual, artefact.residual_sd_db, artefact.model, artefact.protocol, list(artefact.features))
    schema = (
        "a_highway double, a_residential double, b_background double, d0_m double, apply_residual boolean, residual_sd_db double, "
        "delivered_model string, selected_under string, residual_features array<string>"
    )
    df_session.createDataFrame([row], schema).write.mode("overwrite").json(f"{path}/params")
    if artefact.residual is not None:
        artefact.residual.write().overwrite().save(f"{path}/residual")


def read_kernel(spark, path: str):
    """The artefact written by `write_kernel`."""
    from pyspark.ml.regression import GBTRegressionModel

    from soundfield.models.kernel import Kernel
    from soundfield.models.trees import Delivered

    r = spark.read.json(f"{path}/params").first()
    residual = GBTRegressionModel.load(f"{path}/residual") if r["apply_residual"] else None
    kernel = Kernel(r["a_highway"], r["a_residential"], r["b_background"], floor_m=r["d0_m"])
    return Delivered(kernel, residual, tuple(r["residual_features"]), r["apply_residual"], r["residual_sd_db"], r["delivered_model"], r["selected_under"])
