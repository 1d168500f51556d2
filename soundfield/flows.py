"""The three jobs end to end: ingest an export, evaluate and select a model, publish the map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions import geo
from soundfield.models import features as feat
from soundfield.models import selection, trees
from soundfield.operators import cleaning, evaluation, grid
from soundfield.session import cut_lineage
from soundfield.sources import readers, writers

UTM_ZONE = 48


def located(df: DataFrame, zone: int = UTM_ZONE) -> DataFrame:
    """Adds metric x, y from longitude and latitude."""
    x, y = geo.utm_from_lonlat(F.col("longitude"), F.col("latitude"), zone)
    return df.withColumn("x", x).withColumn("y", y)


def ingest(
    spark: SparkSession, directory: str, out: str, *, weather: DataFrame | None = None, centres=C.SITE_CENTRES, offsets: dict[str, float] | None = None
) -> DataFrame:
    """Newest export -> typed -> clean -> site by position -> weather -> published CSV."""
    typed = cleaning.standardize(readers.read_survey_export(spark, directory))
    rows = cleaning.assign_site(cleaning.clean(typed, offsets=offsets), centres)
    if weather is not None:
        rows = cleaning.join_weather(rows, weather)
    writers.write_measurements(rows, out)
    return rows


def build_features(points: DataFrame, buildings: DataFrame, nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Points with all street-geometry and time features."""
    return feat.time_features(points.join(feat.morphology(points, buildings, nodes, roads), ["x", "y"]))


def evaluate_and_select(
    rows: DataFrame, out: str, *, protocols: Sequence[str] = (selection.BLOCK_CV, selection.BUFFERED, selection.BUFFERED_FOLDS, selection.SITE_OUT),
    models: Sequence[str] | None = None, n_boot: int = C.N_BOOT,
) -> trees.Delivered:
    """Scores, gains and per-site tables as files; the selected model fitted on all rows and saved.

    Selection goes by the protocol that scores every candidate with a buffer, if it is among `protocols`.
    """
    predictions, metrics = selection.evaluate(rows, protocols, models, n_boot=n_boot)
    writers.write_table(metrics, f"{out}/metrics", "json")
    writers.write_table(evaluation.paired_gains(metrics, selection.GAIN_PAIRS), f"{out}/gains", "json")
    writers.write_table(evaluation.scores(predictions, ["protocol", "model", "site"]), f"{out}/per_site", "json")
    reference = next((p for p in (selection.BUFFERED_FOLDS, selection.BUFFERED) if p in protocols), protocols[0])
    candidates = [c for c in evaluation.DELIVERABLE if models is None or c in models]
    artefact = selection.select_and_fit(rows, metrics, reference, candidates)
    writers.write_kernel(rows.sparkSession, artefact, f"{out}/model")
    return artefact


def publish_map(
    points: DataFrame, buildings: DataFrame, nodes: DataFrame, roads: DataFrame, artefact: trees.Delivered, out: str, *, zone: int = UTM_ZONE
) -> DataFrame:
    """Grid over every site, features once per cell, one level per cell and hour, files."""
    cells = grid.grid_cells(grid.grid_layout(points))
    found = feat.morphology(cells, buildings, nodes, roads) if artefact.apply_residual else feat.road_distances(cells, roads)
    with_features = cells.join(found, ["x", "y"])
    hourly = feat.time_features(grid.expand_hours(with_features)).withColumn("is_weekend", F.lit(0))
    levels = trees.predict_grid(hourly, artefact)
    lon, lat = geo.lonlat_from_utm(F.col("x"), F.col("y"), zone)
    placed = cut_lineage(levels.withColumn("longitude", lon).withColumn("latitude", lat))  # two files are written from it
    writers.write_noise_map(placed, out)
    return placed
