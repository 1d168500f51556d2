"""Exact grouped quantiles whose cost does not sit in one task.

Spark's `percentile` keeps every distinct value of a group in one buffer.  Here
equal values are counted first, counts are added up per logarithmic bin (few
bins per group), and only the bins that hold a wanted rank are ranked by value.
Results equal linear interpolation between closest ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield.operators.scans import attach, with_scalars

BINS_PER_DOUBLING = 512


def _bin(value: Column) -> Column:
    return (F.signum(value) * F.floor(F.log2(1.0 + F.abs(value)) * BINS_PER_DOUBLING)).cast("bigint")


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """One row per key group: keys plus one column per wanted quantile."""
    keys = list(keys)
    group = keys or ["__all"]
    base = df.select(*keys, value.cast("double").alias("__v")) if keys else df.select(
        F.lit(1).alias("__all"), value.cast("double").alias("__v")
    )
    counts = (
        base.where(F.col("__v").isNotNull())
        .groupBy(*group, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__bin", _bin(F.col("__v")))
    )
    ordered = Window.partitionBy(*group).orderBy("__bin")
    bins = (
        counts.groupBy(*group, "__bin")
        .agg(F.sum("__n").alias("__bn"))
        .select(
            *group, "__bin", "__bn",
            (F.sum("__bn").over(ordered) - F.col("__bn")).alias("__before"),
            F.sum("__bn").over(Window.partitionBy(*group)).alias("__total"),
        )
    )

    def rank(p: float) -> Column:
        return F.lit(p) * (F.col("__total") - 1)

    def holds(position: Column, start: Column, width: Column) -> Column:
        return (position >= start) & (position < start + width)

    hit = F.lit(False)
    for p in wanted.values():
        for position in (F.floor(rank(p)), F.ceil(rank(p))):
            hit = hit | holds(position, F.col("__before"), F.col("__bn"))
    chosen = bins.where(hit).select(*group, "__bin", "__before", "__total")

    inside = Window.partitionBy(*group, "__bin").orderBy("__v")
    ranked = attach(counts, chosen, [*group, "__bin"], "inner").withColumn(
        "__start", F.col("__before") + F.sum("__n").over(inside) - F.col("__n")
    )
    picks = []
    for name, p in wanted.items():
        for part, position in (("lo", F.floor(rank(p))), ("hi", F.ceil(rank(p)))):
            at = F.when(holds(position, F.col("__start"), F.col("__n")), F.col("__v"))
            picks.append(F.max(at).alias(f"__{name}_{part}"))
    result = ranked.groupBy(*group).agg(F.max("__total").alias("__total"), *picks)
    columns = []
    for name, p in wanted.items():
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        columns.append((low + (high - low) * (rank(p) - F.floor(rank(p)))).alias(name))
    return result.select(*keys, *columns)


def grouped_median(df: DataFrame, keys: Sequence[str], value: Column, name: str = "median") -> DataFrame:
    return grouped_quantiles(df, keys, value, {name: 0.5})


def summarise(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], value: Column, wanted: dict[str, float]
) -> DataFrame:
    """Ordinary aggregates and exact quantiles of one value, side by side."""
    keys = list(keys)
    plain = df.groupBy(*keys).agg(*aggregates)
    if not keys:
        return with_scalars(plain, grouped_quantiles(df, [], value, wanted))
    return attach(plain, grouped_quantiles(df, keys, value, wanted), keys)


def order_statistic(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """Value at position int(n * share) of the sorted group, clamped; never interpolated."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__bin", _bin(F.col("__v")))
    ordered = Window.partitionBy(*keys).orderBy("__bin")
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__bn")).select(
        *keys, "__bin", "__bn",
        (F.sum("__bn").over(ordered) - F.col("__bn")).alias("__before"),
        F.sum("__bn").over(Window.partitionBy(*keys)).alias("__total"),
    )
    position = F.least(F.floor(F.col("__total") * F.lit(share)), F.col("__total") - 1)
    chosen = bins.where((position >= F.col("__before")) & (position < F.col("__before") + F.col("__bn")))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__v")
    ranked = attach(counts, chosen.drop("__bn"), [*keys, "__bin"], "inner").withColumn(
        "__start", F.col("__before") + F.sum("__n").over(inside) - F.col("__n")
    )
    return ranked.where((position >= F.col("__start")) & (position < F.col("__start") + F.col("__n"))).select(
        *keys, F.col("__v").alias(name)
    )
