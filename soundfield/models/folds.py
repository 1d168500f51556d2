"""Fold assignment: grouped k-fold, site folds, hash splits by row or by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.operators.scans import dense_index, running_totals, with_scalars
from soundfield.session import cut_lineage


def _lightest_first(histogram: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy fold pattern from a histogram of block sizes.

    Blocks go by falling size, each to the lightest fold (lowest number on a
    tie).  Equal sizes are handled as runs: while the same folds keep taking
    turns the pattern repeats, so a run is (size, first index, length, cycle).
    Work depends on the number of distinct sizes, not of blocks.
    """
    load = [0] * k
    runs: list[tuple[int, int, int, list[int]]] = []
    for size, count in sorted(histogram, reverse=True):
        at = 0
        while at < count:
            lightest = min(load)
            turn = sorted((load[f], f) for f in range(k) if load[f] < lightest + size)
            rest = [load[f] for f in range(k) if load[f] >= lightest + size]
            # whole rounds in which no other fold becomes the lightest
            room = (min(rest) - max(w for w, _ in turn)) // size if rest else count
            rounds = min(max(room, 0), (count - at) // len(turn))
            if rounds > 0:
                runs.append((size, at, rounds * len(turn), [f for _, f in turn]))
                for _, f in turn:
                    load[f] += rounds * size
                at += rounds * len(turn)
            else:
                fold = min(range(k), key=lambda f: (load[f], f))
                runs.append((size, at, 1, [fold]))
                load[fold] += size
                at += 1
    return runs


def block_folds(df: DataFrame, n_folds: int = C.N_FOLDS) -> DataFrame:
    """Fold of every block (block_x, block_y): blocks by falling size, each to the lightest fold.

    The driver sees the histogram of block sizes only (distinct sizes, at most
    about sqrt(2 x rows)); blocks of one size are numbered in (block_x, block_y) order.
    """
    spark = df.sparkSession
    blocks = cut_lineage(df.groupBy("block_x", "block_y").agg(F.count(F.lit(1)).alias("size")))
    histogram = [(r["size"], r["blocks"]) for r in blocks.groupBy("size").agg(F.count(F.lit(1)).alias("blocks")).collect()]
    total = sum(c for _, c in histogram)
    runs = _lightest_first(histogram, max(min(n_folds, total), 1))
    table = spark.createDataFrame(runs, "size bigint, first bigint, length bigint, cycle array<int>")
    numbered = running_totals(blocks, ["size"], F.col("block_x"), [F.col("block_x"), F.col("block_y")], {"i": F.lit(1).cast("bigint")})
    inside = (F.col("i") >= F.col("first")) & (F.col("i") < F.col("first") + F.col("length"))
    turn = ((F.col("i") - F.col("first")) % F.size("cycle")).cast("int")
    return numbered.join(table, "size").where(inside).select("block_x", "block_y", F.get("cycle", turn).alias("fold"))


def with_block_folds(df: DataFrame, n_folds: int = C.N_FOLDS) -> DataFrame:
    return df.join(block_folds(df, n_folds), ["block_x", "block_y"])


def _key(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Repeatable row split by a keyed hash, no shuffle."""
    u = F.conv(F.substring(_key(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    return df.withColumn(name, u < test_share)


def group_split(df: DataFrame, group: str, train_share: float, seed: int = 42, name: str = "is_train") -> DataFrame:
    """Whole groups to one side: the first round(share x groups) in keyed-hash order train."""
    groups = df.select(group).distinct().withColumn("h", _key(seed, F.col(group)))
    ordered = dense_index(groups, F.substring("h", 1, 3), [F.col("h"), F.col(group)], "i")
    n = groups.agg(F.count(F.lit(1)).alias("g"))
    side = with_scalars(ordered, n)
    return df.join(side.select(group, (F.col("i") < F.round(F.col("g") * train_share)).alias(name)), group)
