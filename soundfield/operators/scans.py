"""Ordered scans that do not need a whole group in one task.

A window over `keys` alone puts a hot key into one task.  Here the rows of a
key are cut into ordered chunks; the wide window runs inside a chunk and a
second one runs over one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null, keeping one copy of them."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery: no join."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("__s")).scalar()
    return df.withColumn("__s", packed).select(*df.columns, *[F.col(f"__s.{n}").alias(n) for n in names])


def previous_value(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Add the value of the preceding row of the same keys.

    `chunk` must not decrease along `order`.
    """
    cut = df.withColumn("__chunk", chunk)
    inner = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    last = cut.groupBy(*keys, "__chunk").agg(F.max_by(F.col(value), F.struct(*order)).alias("__last"))
    over_chunks = Window.partitionBy(*keys).orderBy("__chunk")
    carried = last.select(*keys, "__chunk", F.lag("__last").over(over_chunks).alias("__carried"))
    return (
        attach(cut.withColumn(name, F.lag(value).over(inner)), carried, [*keys, "__chunk"])
        .withColumn(name, F.coalesce(name, "__carried"))
        .drop("__chunk", "__carried")
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], sums: dict[str, Column]
) -> DataFrame:
    """Add, for each entry of `sums`, its total over the rows strictly before.

    `chunk` must not decrease along `order`.
    """
    cut = df.withColumn("__chunk", chunk)
    for name, expr in sums.items():
        cut = cut.withColumn(f"__v_{name}", expr)
    before = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = cut.groupBy(*keys, "__chunk").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before_chunk = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys, "__chunk", *[F.coalesce(F.sum(f"__t_{n}").over(before_chunk), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    inside = cut.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(before), F.lit(0)).alias(f"__i_{n}") for n in sums])
    out = attach(inside, offsets, [*keys, "__chunk"])
    for name in sums:
        out = out.withColumn(name, F.col(f"__i_{name}") + F.col(f"__o_{name}"))
    return out.drop("__chunk", *[f"__{p}_{n}" for n in sums for p in "vio"])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    `row_number() = 1` lets Spark drop all but one row per key and map task
    before the shuffle (window group limit), so a hot key stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def flag_repeats(df: DataFrame, keys: Sequence[str], order: Column, name: str = "repeat") -> DataFrame:
    """True on every row of a key but the first; only the minimum is shuffled per key."""
    first = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    return attach(df, first, keys).withColumn(name, order != F.col("__first")).drop("__first")


def dense_index(df: DataFrame, chunk: Column, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Zero-based position of each row in a total order, without one global window over all rows."""
    return running_totals(df.withColumn("__all", F.lit(1)), ["__all"], chunk, order, {name: F.lit(1).cast("bigint")}).drop("__all")
