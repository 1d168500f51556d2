"""From survey answers to clean, located, de-duplicated measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions import survey, timing
from soundfield.operators.scans import keep_first

_STRICT_NUMBERS = ("latitude", "longitude", "altitude", "accuracy", "noise_db")
_LENIENT_NUMBERS = ("dist_to_source_m", "count_motorbikes", "count_cars", "count_heavy", "count_ev")
_TEXTS = ("class", "site", "collector", "contributor_id", "dist_to_road", "note",
          "phone_orientation", "mic_to_source", "construction_nearby")


def standardize(answers: DataFrame, zone: str = C.LOCAL_ZONE) -> DataFrame:
    """Typed projection of an all-text survey table.

    Position and level must be numbers: junk fails the job.  Counts and source distance become null instead.
    """
    have = set(answers.columns)

    def text(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    def strict(name: str) -> Column:
        value = F.trim(text(name))
        number = value.try_cast("double")
        junk = (value != "") & number.isNull()
        return F.when(junk, F.raise_error(F.concat(F.lit(f"{name} is not a number: "), value)).cast("double")).otherwise(number)

    columns = [timing.utc_to_local(text("timestamp"), zone).alias("timestamp")]
    columns += [strict(n).alias(n) for n in _STRICT_NUMBERS]
    columns += [text(n).alias(n) for n in _TEXTS]
    columns += [text(n).try_cast("double").alias(n) for n in _LENIENT_NUMBERS]
    if "seq" in have:
        columns.append(F.col("seq"))
    typed = answers.select(*columns)
    return (
        typed.withColumn("collector", survey.normalise_name(F.col("collector")))
        .withColumn("dist_to_road", survey.recode(F.col("dist_to_road"), C.DISTANCE_BANDS))
        .withColumn("phone_orientation", F.coalesce("phone_orientation", F.lit("horizontal")))
        .withColumn("mic_to_source", F.coalesce("mic_to_source", F.lit("towards")))
        .withColumn("construction_nearby", survey.construction_backfill(F.col("construction_nearby"), F.col("class")))
    )


def clean(
    df: DataFrame,
    *,
    level: str = "noise_db",
    time: str = "timestamp",
    position: Sequence[str] = ("latitude", "longitude"),
    dedup_time: Column | None = None,
    order: str = "seq",
    offsets: dict[str, float] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Null filter, keep-first per (person, time), accuracy and level bounds, offset, calendar.

    The order matters: a duplicate is dropped before the bounds are looked at.
    `strict` is the second-city rule: accuracy and time must be present.
    """
    required = [level, *position] + ([time] if strict else [])
    rows = df.dropna(subset=required)
    rows = rows.withColumn("__who", survey.dedup_key(F.col("contributor_id"), F.col("collector")))
    rows = rows.withColumn("__when", F.col(time) if dedup_time is None else dedup_time)
    rows = keep_first(rows, ["__who", "__when"], [F.col(order)]).drop("__who", "__when")
    accurate = F.col("accuracy") < 50
    if not strict:
        accurate = F.col("accuracy").isNull() | accurate
    rows = rows.where(accurate).where(F.col(level).between(20, 120))
    table = C.CALIBRATION_OFFSETS if offsets is None else offsets
    return (
        rows.withColumn(level, F.col(level) + survey.offset_for(F.col("collector"), table))
        .withColumn("hour", F.hour(time))
        .withColumn("is_weekend", timing.is_weekend(F.col(time)))
        .withColumn("day_of_week", timing.day_name(F.col(time)))
    )


def nearest_centre(x: Column, y: Column, centres: Sequence[tuple[str, float, float]]) -> Column:
    """Name of the nearest of a fixed list of centres, first wins; squared coordinate distance."""
    options = F.array(*[
        F.struct(
            (F.pow(x - float(cx), 2) + F.pow(y - float(cy), 2)).alias("d2"), F.lit(i).alias("i"), F.lit(name).alias("name")
        )
        for i, (name, cx, cy) in enumerate(centres)
    ])
    return F.array_min(options)["name"]


def assign_site(
    df: DataFrame, centres: Sequence[tuple[str, float, float]], x: str = "latitude", y: str = "longitude"
) -> DataFrame:
    """Replace `site` by the nearest centre; the declared label stays in `site_declared`."""
    return df.withColumn("site_declared", F.col("site")).withColumn("site", nearest_centre(F.col(x), F.col(y), centres))


def site_corrections(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("site_declared").isNotNull() & (F.col("site_declared") != F.col("site")))


def centre_or_outside(latitude: Column, longitude: Column, centres=C.SITE_CENTRES, reach: float = C.SITE_RADIUS_M) -> Column:
    """struct(site, distance_m, outside): nearest centre by great circle, refused beyond `reach`."""
    from soundfield.functions.geo import haversine

    options = F.array(*[
        F.struct(haversine(latitude, longitude, F.lit(lat), F.lit(lon)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n"))
        for i, (n, lat, lon) in enumerate(centres)
    ])
    best = F.array_min(options)
    return F.struct(best["n"].alias("site"), best["d"].alias("distance_m"), (best["d"] > reach).alias("outside"))


def published(df: DataFrame) -> DataFrame:
    """Only the columns that may be published; people never appear."""
    extras = [c for c in C.PUBLISHED_EXTRAS if c in df.columns]
    return df.select(*C.PUBLISHED_COLUMNS, *extras)


def join_weather(df: DataFrame, weather: DataFrame, *, time: str = "timestamp") -> DataFrame:
    """Left join on (hour, site); `weather` has time_h and site."""
    return df.withColumn("time_h", timing.floor_to_hour(F.col(time))).join(weather, ["time_h", "site"], "left").drop("time_h")
