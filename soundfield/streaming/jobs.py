"""Structured Streaming jobs: cleaning, windowed levels, sessions, meter levels, matching.

Event time is TIMESTAMP (watermarks refuse TIMESTAMP_NTZ).  Each job has a batch
twin with the same result on the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from soundfield import config as C
from soundfield.functions import levels, survey
from soundfield.operators.scans import keep_first, previous_value, running_totals

SLOW_S, FAST_S = 1.0, 0.125


def with_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


# ---------------------------------------------------------------------- clean, levels


def clean_stream(
    stream: DataFrame, *, delay: str = "10 minutes", offsets: dict[str, float] | None = None, order: str = "seq"
) -> DataFrame:
    """Streaming form of cleaning: per (person, time) the row that is least by `order`, whichever arrives first, then bounds and offset.

    A group keeps its least row only and gives it out once the watermark has passed its time; rows that come later than the
    delay, and rows without a time, are dropped.
    """
    rows = stream.dropna(subset=["noise_db", "x", "y"])
    rows = rows.withColumn("who", survey.dedup_key(F.col("contributor_id"), F.col("collector")))
    others = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("who", "ts")])
    first = rows.withWatermark("ts", delay).groupBy("who", "ts").agg(F.min_by(others, F.col(order)).alias("first"))
    return _bounds(first.select("first.*", "who", "ts"), offsets)


def clean_batch(df: DataFrame, *, offsets: dict[str, float] | None = None, order: str = "seq") -> DataFrame:
    rows = df.dropna(subset=["noise_db", "x", "y"])
    rows = rows.withColumn("who", survey.dedup_key(F.col("contributor_id"), F.col("collector")))
    return _bounds(keep_first(rows, ["who", "ts"], [F.col(order)]), offsets)


def _bounds(rows: DataFrame, offsets: dict[str, float] | None) -> DataFrame:
    table = C.CALIBRATION_OFFSETS if offsets is None else offsets
    kept = rows.where(F.col("accuracy").isNull() | (F.col("accuracy") < 50)).where(F.col("noise_db").between(20, 120))
    return kept.withColumn("noise_db", F.col("noise_db") + survey.offset_for(F.col("collector"), table)).withColumn("hour", F.hour("ts"))


def windowed_levels(
    rows: DataFrame, *, key: str = "site", width: str = "1 hour", slide: str | None = None, delay: str | None = "10 minutes"
) -> DataFrame:
    """Equivalent level per key and tumbling or sliding window; rows later than the delay are dropped."""
    marked = rows if delay is None else rows.withWatermark("ts", delay)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(window.alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), levels.energy_mean_level(F.col("noise_db")).alias("laeq_db")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "laeq_db")


def sessions(rows: DataFrame, *, key: str = "collector", gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """Visits of a collector: runs of rows with no pause longer than the gap."""
    if delay is None:
        return _sessions_batch(rows, key, gap)
    return rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), levels.energy_mean_level(F.col("noise_db")).alias("laeq_db")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "laeq_db")


def _sessions_batch(rows: DataFrame, key: str, gap: str) -> DataFrame:
    """Same sessions by chunked scans over days, so that one busy collector is not one task."""
    pause = F.expr(f"interval {gap}")
    instants = rows.where("ts is not null").groupBy(key, "ts").agg(
        F.count(F.lit(1)).alias("n"), F.sum(levels.to_energy(F.col("noise_db"))).alias("e"), F.count("noise_db").alias("m")
    )
    day = F.unix_date(F.to_date("ts"))
    seen = previous_value(instants, [key], day, [F.col("ts")], "ts", "before")
    fresh = F.when(F.col("before").isNull() | (F.col("ts") > F.col("before") + pause), 1).otherwise(0)
    # sessions started up to and including this row
    counted = running_totals(seen.withColumn("fresh", fresh), [key], day, [F.col("ts")], {"started": F.col("fresh")})
    numbered = counted.withColumn("session", F.col("started") + F.col("fresh"))
    return numbered.groupBy(key, "session").agg(
        F.min("ts").alias("start"), (F.max("ts") + pause).alias("end"), F.sum("n").alias("n"),
        (10.0 * F.log10(F.sum("e") / F.sum("m"))).alias("laeq_db"),
    ).select("start", "end", key, "n", "laeq_db")


def live_exceedance(rows: DataFrame, *, key: str = "site", width: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Windows whose level is over the limit of the hour they start in."""
    table = windowed_levels(rows, key=key, width=width, delay=delay)
    limit = levels.limit_for(F.hour("start"))
    return table.withColumn("limit_db", limit).withColumn("over", F.col("laeq_db") > F.col("limit_db"))


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink, one folder per batch: a batch run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


# ------------------------------------------------------------------------- meter level


def _exponential(times_us: np.ndarray, squares: np.ndarray, tau: float, state: tuple[float, int] | None) -> np.ndarray:
    """m += (1 - exp(-dt / tau)) (x^2 - m), primed by the first reading."""
    out = np.empty(len(squares))
    m, last = state if state is not None else (None, None)
    for i, (t, x2) in enumerate(zip(times_us.tolist(), squares.tolist())):
        m = x2 if m is None else m + (1.0 - math.exp(-(t - last) / 1e6 / tau)) * (x2 - m)
        last = t
        out[i] = m
    return out


_METER_OUT = "device string, t_us bigint, seq bigint, level_db double"


def _level(m: np.ndarray) -> np.ndarray:
    return 10.0 * np.log10(np.maximum(m, 1e-30))


def meter_stream(readings: DataFrame, tau: float = SLOW_S) -> DataFrame:
    """Time-weighted level per device (device, t_us, seq, pressure); readings older than the state are dropped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["t_us", "seq"], kind="stable")
        kept = state.get if state.exists else None
        if kept is not None:
            pdf = pdf[pdf["t_us"] > kept[1]]
        if pdf.empty:
            return
        m = _exponential(pdf["t_us"].to_numpy(), pdf["pressure"].to_numpy() ** 2, tau, kept)
        state.update((float(m[-1]), int(pdf["t_us"].iloc[-1])))
        yield pd.DataFrame({"device": key[0], "t_us": pdf["t_us"].to_numpy(), "seq": pdf["seq"].to_numpy(), "level_db": _level(m)})

    return readings.groupBy("device").applyInPandasWithState(
        step, _METER_OUT, "m double, last_us bigint", "append", GroupStateTimeout.NoTimeout
    )


def meter_batch(readings: DataFrame, tau: float = SLOW_S, slice_s: int = 600) -> DataFrame:
    """Batch twin: devices are cut into time slices, each warmed up by the 80 tau before it.

    After 80 tau an old reading weighs e^-80, below double precision over the
    whole range of levels, so slices are independent and a busy device is spread
    over many tasks.
    """
    warm_us, slice_us = int(80 * tau * 1e6), slice_s * 1_000_000
    own = F.floor(F.col("t_us") / slice_us).cast("bigint")
    reach = F.floor((F.col("t_us") + warm_us) / slice_us).cast("bigint")
    cut = readings.withColumn("__own", own).withColumn("__slice", F.explode(F.sequence(own, reach)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_us", "seq"], kind="stable")
        m = _exponential(pdf["t_us"].to_numpy(), pdf["pressure"].to_numpy() ** 2, tau, None)
        out = pd.DataFrame({"device": pdf["device"].to_numpy(), "t_us": pdf["t_us"].to_numpy(), "seq": pdf["seq"].to_numpy(), "level_db": _level(m)})
        return out[(pdf["__own"] == pdf["__slice"]).to_numpy()]

    return cut.groupBy("device", "__slice").applyInPandas(fold, _METER_OUT)


# --------------------------------------------------------------------- video matching


def match_stream(videos: DataFrame, measurements: DataFrame, *, within_s: int = C.MATCH_MAX_S, delay: str = "30 minutes") -> DataFrame:
    """Candidate matches of two streams: video_id, start, seq, ts, noise_db, gap_us.

    Streams join on equal time buckets (a video looks into the buckets around
    it) and a time bound, which lets Spark forget old rows.  Only the first
    measurement of an instant can win, so repeats are dropped before the join.
    """
    def bucket(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / (within_s * 1_000_000)).cast("bigint")

    v = videos.withWatermark("start", delay).withColumn(
        "b", F.explode(F.sequence(bucket(F.col("start")) - 1, bucket(F.col("start")) + 1))
    )
    m = measurements.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ts"]).withColumn("mb", bucket(F.col("ts")))
    span = F.expr(f"interval {within_s} seconds")
    bound = (F.col("b") == F.col("mb")) & (F.col("ts") >= F.col("start") - span) & (F.col("ts") <= F.col("start") + span)
    gap = F.abs(F.unix_micros("ts") - F.unix_micros("start"))
    return v.join(m, bound).select("video_id", "start", "seq", "ts", "noise_db", gap.alias("gap_us"))


def best_match_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: per batch only the best candidate of each video is kept."""
    write = append_to(path)

    def reduce_and_write(batch: DataFrame, batch_id: int) -> None:
        write(keep_first(batch, ["video_id"], [F.col("gap_us"), F.col("seq")]), batch_id)

    return reduce_and_write


def best_matches(candidates: DataFrame) -> DataFrame:
    """Best match of each video over everything the sink wrote."""
    return keep_first(candidates, ["video_id"], [F.col("gap_us"), F.col("seq")])
