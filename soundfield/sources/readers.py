"""Readers: survey exports, registers, shards, minute levels, GeoJSON, clip bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: parts of column titles that identify a survey answer, in order of preference
SURVEY_COLUMNS = {
    "timestamp": ("start",),
    "latitude": ("_latitude", "location_latitude"),
    "longitude": ("_longitude", "location_longitude"),
    "altitude": ("_altitude", "location_altitude"),
    "accuracy": ("_precision", "location_precision"),
    "noise_db": ("noise level", "noise_db"),
    "class": ("noise category", "noise_class"),
    "site": ("study site", "site"),
    "collector": ("who is collecting", "collector"),
    "contributor_id": ("contributor_id", "contributor"),
    "dist_to_road": ("distance to nearest road", "dist_to_road"),
    "note": ("note",),
    "phone_orientation": ("phone held", "phone_orientation"),
    "mic_to_source": ("mic relative", "mic_to_source"),
    "dist_to_source_m": ("distance to the main source", "dist_to_source_m"),
    "count_motorbikes": ("motorbikes passing", "count_motorbikes"),
    "count_cars": ("cars passing", "count_cars"),
    "count_heavy": ("buses / trucks", "count_heavy"),
    "count_ev": ("electric vehicles", "count_ev"),
    "construction_nearby": ("construction/demolition audible", "construction_nearby"),
}


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob on any file system Spark can reach."""
    jvm, context = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def resolve_column(columns: Sequence[str], keys: Sequence[str]) -> str | None:
    """First title that contains a key, ignoring case: keys in order, then columns in order."""
    return next((c for k in keys for c in columns if k.lower() in c.lower()), None)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV; semicolons first, commas if that leaves one column.  Only the header is read here.

    A quoted field may hold line breaks, so a file is one task; exports come as many files of modest size.
    """
    options = {"header": True, "multiLine": True, "escape": '"'}
    df = spark.read.options(sep=";", **options).csv(path)
    return df if len(df.columns) > 1 else spark.read.options(sep=",", **options).csv(path)


def _input_order(df: DataFrame) -> DataFrame:
    """Adds `seq`, comparable in file order."""
    return df.withColumn(
        "seq", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    )


def latest_export(spark: SparkSession, directory: str) -> str:
    """Newest survey export by name; our own output and the construction register do not count."""
    names = [
        p for p in list_files(spark, f"{directory.rstrip('/')}/*.csv")
        if not p.endswith("measurements.csv") and "construction" not in p.lower().rsplit("/", 1)[-1]
    ]
    if not names:
        raise FileNotFoundError(f"no survey export in {directory}")
    return max(names)


def read_survey_export(spark: SparkSession, directory: str) -> DataFrame:
    """Newest export as text columns with standard names, plus `seq`; absent answers are left out."""
    raw = _input_order(read_delimited(spark, latest_export(spark, directory)))
    titles = [c for c in raw.columns if c != "seq"]
    picked = {name: resolve_column(titles, keys) for name, keys in SURVEY_COLUMNS.items()}
    return raw.select("seq", *[F.col(f"`{c}`").alias(n) for n, c in picked.items() if c is not None])


def read_construction_register(spark: SparkSession, directory: str) -> DataFrame:
    """latitude, longitude, site_type, activity, loud; rows without a position are dropped."""
    files = list_files(spark, f"{directory.rstrip('/')}/*onstruction*.csv")
    if not files:
        raise FileNotFoundError(f"no construction register in {directory}")
    raw = read_delimited(spark, max(files))
    where = [c for c in raw.columns if "_Construction site location" in c]
    if len(where) < 2:
        raise ValueError("the register has no location columns")
    activity = next((c for c in raw.columns if "Activity level" in c), None)
    kind = next((c for c in raw.columns if c.strip() == "Type"), None)
    text = F.col(f"`{activity}`") if activity else F.lit("")
    return raw.select(
        F.col(f"`{where[0]}`").try_cast("double").alias("latitude"), F.col(f"`{where[1]}`").try_cast("double").alias("longitude"),
        (F.col(f"`{kind}`") if kind else F.lit("Construction")).alias("site_type"), text.alias("activity"),
        F.coalesce(text.rlike("(?i)loud"), F.lit(False)).cast("int").alias("loud"),
    ).dropna(subset=["latitude", "longitude"])


MEASUREMENT_SCHEMA = (
    "latitude double, longitude double, noise_db double, timestamp string, class string, site string, hour int, is_weekend int, "
    "temperature_2m double, wind_speed_10m double, precipitation double, dist_to_road string, count_motorbikes double, "
    "count_cars double, count_heavy double, count_ev double, construction_nearby string, dist_to_source_m double"
)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Published measurements; columns are taken by name, times with or without a fraction."""
    header = spark.read.option("header", True).csv(path).columns
    types = dict(part.strip().split(" ") for part in MEASUREMENT_SCHEMA.split(","))
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn("timestamp", F.try_to_timestamp("timestamp").cast("timestamp_ntz"))


def read_shards(spark: SparkSession, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Parquet shards, named columns only: the scan reads no others."""
    return spark.read.parquet(pattern).select(*columns)


def read_minute_levels(spark: SparkSession, pattern: str, zone: str = "Europe/Madrid") -> DataFrame:
    """Monthly files of one-minute levels: sensor, local time, level.  Plain or gzipped CSV."""
    from soundfield.functions.timing import utc_to_local

    raw = spark.read.option("header", True).csv(pattern)
    return raw.select(
        F.col("Id_Instal").alias("sensor"), utc_to_local(F.col("Timestamp_local"), zone).alias("ts"),
        F.col("Nivell_LAeq_1min").cast("double").alias("noise_db"),
    )


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: properties, geometry_type, coordinates."""
    doc = spark.read.option("multiLine", True).json(path)
    f = doc.select(F.explode("features").alias("f"))
    return f.select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_clip_bytes(spark: SparkSession, pattern: str) -> DataFrame:
    """Clip files as bytes with their hash; files stay apart, so memory is one clip per task."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "content", F.md5("content").alias("md5"))
