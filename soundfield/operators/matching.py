"""Joins in time and between observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundfield.operators.scans import keep_first


def nearest_in_time(
    left: DataFrame, right: DataFrame, *, left_us: str, right_us: str, tolerance_us: int, order: str = "seq"
) -> DataFrame:
    """Each left row with the right row nearest in time, or nulls beyond the tolerance.

    Times are integer microseconds.  Equal gaps go to the right row that comes
    first in `order`.  No pairs are formed: distinct instants of both sides are
    laid on one time line cut into buckets of the tolerance; inside a bucket the
    last and next instants come from a window, across its borders from the
    neighbouring buckets' first and last instants.
    """
    carried = [c for c in right.columns if c != right_us]
    asked = left.where(F.col(left_us).isNotNull()).select(F.col(left_us).alias("__t")).distinct()
    best = keep_first(right.where(F.col(right_us).isNotNull()), [right_us], [F.col(order)])
    best = best.select(F.col(right_us).alias("__t"), F.struct(*carried).alias("__row"))

    def bucket(column: str):
        return F.floor(F.col(column) / F.lit(tolerance_us)).cast("bigint")

    instants = best.select("__t", F.struct(F.col("__t").alias("t"), F.col("__row").alias("row")).alias("__hit"))
    ends = instants.withColumn("__b", bucket("__t")).groupBy("__b").agg(
        F.min_by("__hit", "__t").alias("__first"), F.max_by("__hit", "__t").alias("__last")
    )
    line = asked.select("__t", F.lit(None).cast(instants.schema["__hit"].dataType).alias("__hit"), F.lit(True).alias("__asked"))
    line = line.unionByName(instants.withColumn("__asked", F.lit(False))).withColumn("__b", bucket("__t"))
    back = Window.partitionBy("__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("__b").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("__before", F.last("__hit", ignorenulls=True).over(back)).withColumn(
        "__after", F.last("__hit", ignorenulls=True).over(ahead)
    ).where("__asked")
    previous = ends.select((F.col("__b") + 1).alias("__b"), F.col("__last").alias("__carry_back"))
    following = ends.select((F.col("__b") - 1).alias("__b"), F.col("__first").alias("__carry_ahead"))
    line = line.join(previous, "__b", "left").join(following, "__b", "left")

    def candidate(hit):
        gap = F.abs(hit["t"] - F.col("__t"))
        return F.when(hit.isNotNull() & (gap <= tolerance_us), F.struct(gap.alias("gap_us"), hit["row"][order].alias("__o"), hit["row"].alias("row")))

    before = candidate(F.coalesce("__before", "__carry_back"))
    after = candidate(F.coalesce("__after", "__carry_ahead"))
    first_of_two = (before["gap_us"] < after["gap_us"]) | ((before["gap_us"] == after["gap_us"]) & (before["__o"] <= after["__o"]))
    chosen = F.when(after.isNull() | first_of_two, before).otherwise(after)
    matched = line.select("__t", chosen.alias("__m")).where(F.col("__m").isNotNull()).select(
        F.col("__t").alias("__lt"), F.col("__m.gap_us").alias("gap_us"), F.col("__m.row.*")
    )
    return left.join(matched, left[left_us] == matched["__lt"], "left").drop("__lt")


def with_site_of_match(counts: DataFrame, measurements: DataFrame, *, on: str = "matched_ts", time: str = "ts") -> DataFrame:
    """Left equi-join on the matched time; repeats rows where that time repeats."""
    sites = measurements.select(F.col(time).alias("__ts"), "site")
    return counts.join(sites, counts[on] == sites["__ts"], "left").drop("__ts")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: empty when a join on them cannot fan out."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return keep_first(df, [key], [F.col(order)])


def pending(videos: DataFrame, done: DataFrame, key: str = "video") -> DataFrame:
    """Videos not counted yet; the same file name in two folders is one video."""
    return videos.join(done.select(key).distinct(), key, "left_anti")


def covered(measurements: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return measurements.join(matches.select(key).where(F.col(key).isNotNull()), key, "left_semi")
