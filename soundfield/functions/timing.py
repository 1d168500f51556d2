"""Timestamps, calendar features and file-name conventions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundfield import config as C


def utc_to_local(text: Column, zone: str = C.LOCAL_ZONE) -> Column:
    """ISO-8601 text with an offset -> naive local TIMESTAMP_NTZ.

    Independent of the session zone: the instant is taken first, then moved
    with an explicit source and target zone.
    """
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp(text).cast("timestamp_ntz"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts).isin(5, 6).cast("int")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def hour_sin(hour: Column) -> Column:
    return F.sin(hour * (2.0 * math.pi) / 24.0)


def hour_cos(hour: Column) -> Column:
    return F.cos(hour * (2.0 * math.pi) / 24.0)


VIDEO_NAME = r"(20\d{6})_(\d{6})"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def video_start(name: Column) -> Column:
    """Start of a recording from its file name; null if the name carries none."""
    stamp = F.concat(F.regexp_extract(name, VIDEO_NAME, 1), F.regexp_extract(name, VIDEO_NAME, 2))
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


ISO6709 = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"


def iso6709_latitude(text: Column) -> Column:
    return F.regexp_extract(text, ISO6709, 1).try_cast("double")


def iso6709_longitude(text: Column) -> Column:
    return F.regexp_extract(text, ISO6709, 2).try_cast("double")


def geopoint_part(text: Column, index: int) -> Column:
    """Part 1..4 of a "lat lon alt acc" answer."""
    return F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(index)).try_cast("double")


def floor_to_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")
