"""Scores, bootstrap intervals, rankings and transfer diagnostics of predictions.

Prediction tables are long: protocol, model, y, p and what else a function names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions.numbers import correlation
from soundfield.operators.quantiles import grouped_quantiles, summarise
from soundfield.operators.scans import attach, running_totals, with_scalars
from soundfield.session import cut_lineage


def _r2() -> Column:
    sst = F.var_pop("y") * F.count("y")
    return 1.0 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / F.when(sst > 0, sst)


def _r() -> Column:
    return F.when(F.stddev_pop("p") > 1e-9, correlation("y", "p"))


def scores(predictions: DataFrame, keys: Sequence[str] = ("protocol", "model")) -> DataFrame:
    """n, r, R2, MAE, RMSE of each group; rows without a prediction are left out."""
    e = F.col("y") - F.col("p")
    return predictions.where(F.col("p").isNotNull() & F.col("y").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), _r().alias("r"), _r2().alias("r2"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def validation_stats(joined: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bias, MAE, RMSE, r, R2, shares within 3 and 5 dB, median cell distance."""
    e = F.col("error")
    rows = joined.withColumn("y", F.col("noise_db")).withColumn("p", F.col("sim_db"))
    return summarise(
        rows, keys,
        [
            F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"), correlation("y", "p").alias("r"), _r2().alias("r2"),
            (100.0 * F.avg((F.abs(e) <= 3).cast("double"))).alias("within3"),
            (100.0 * F.avg((F.abs(e) <= 5).cast("double"))).alias("within5"),
        ],
        F.col("cell_dist_m"), {"median_cell_dist_m": 0.5},
    )


def transfer_diagnostics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What is left of a transferred model raw, without its bias, and without bias and scale."""
    rows = predictions.where(F.col("p").isNotNull() & F.col("y").isNotNull())
    e = F.col("y") - F.col("p")
    sst = F.var_pop("y") * F.count("y")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), _r2().alias("r2_raw"),
        (1.0 - F.var_pop(e) * F.count("y") / F.when(sst > 0, sst)).alias("r2_bias_removed"),
        F.pow(correlation("y", "p"), 2).alias("r2_bias_and_scale_removed"), correlation("y", "p").alias("r"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg("p") - F.avg("y")).alias("bias"), F.regr_slope("y", "p").alias("slope"),
    )


def offset_per_fold(predictions: DataFrame, fold: str = "fold") -> DataFrame:
    """Adds p_offset: the prediction shifted by the mean residual of the other folds."""
    per = predictions.where("p is not null").groupBy(fold).agg(
        F.sum(F.col("y") - F.col("p")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    # one row per fold
    everything = Window.partitionBy(F.lit(1))
    rest = F.sum("n").over(everything) - F.col("n")
    offsets = per.select(fold, ((F.sum("s").over(everything) - F.col("s")) / F.when(rest > 0, rest)).alias("offset_db"))
    return attach(predictions, offsets, [fold]).withColumn("p_offset", F.col("p") + F.col("offset_db"))


def bootstrap_intervals(
    predictions: DataFrame, keys: Sequence[str] = ("protocol", "model"), *, n_boot: int = C.N_BOOT, seed: int = C.SEED
) -> DataFrame:
    """95 % intervals of R2 and MAE, whole blocks (block_x, block_y) drawn with replacement.

    Blocks are reduced to sums first; draw j of replicate b takes block
    md5(seed:b:j) mod n_blocks, counted in (block_x, block_y) order, the same for every
    model with as many blocks.  Rows drawn: n_boot x n_blocks per block count.
    """
    keys = list(keys)
    rows = predictions.where(F.col("p").isNotNull() & F.col("y").isNotNull())
    centre = rows.groupBy(*keys).agg(F.avg("y").alias("__mu"))
    e = F.col("y") - F.col("p")
    z = F.col("y") - F.col("__mu")
    blocks = cut_lineage(attach(rows, centre, keys).groupBy(*keys, "block_x", "block_y").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(z).alias("sy"), F.sum(z * z).alias("syy"),
        F.sum(e * e).alias("see"), F.sum(F.abs(e)).alias("sae"),
    ))
    indexed = running_totals(blocks, keys, F.col("block_x"), [F.col("block_x"), F.col("block_y")], {"idx": F.lit(1).cast("bigint")})
    sizes = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    indexed = attach(indexed, sizes, keys)
    draws = sizes.select("nb").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draws = draws.repartition("nb", "b").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
    text = F.concat_ws(":", F.lit(seed).cast("string"), F.col("b").cast("string"), F.col("j").cast("string"))
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.col("nb")
    times = draws.select("nb", "b", drawn.alias("idx")).groupBy("nb", "b", "idx").agg(F.count(F.lit(1)).alias("times"))
    sums = times.join(indexed, ["nb", "idx"]).groupBy(*keys, "b").agg(
        *[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "sy", "syy", "see", "sae")]
    )
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    both = F.array(
        F.struct(F.lit("r2").alias("metric"), (1.0 - F.col("see") / sst).alias("v")),
        F.struct(F.lit("mae").alias("metric"), (F.col("sae") / F.col("n")).alias("v")),
    )
    reps = sums.where(sst > 0).select(*keys, F.explode(both).alias("m")).select(*keys, "m.metric", "m.v")
    edges = grouped_quantiles(reps, [*keys, "metric"], F.col("v"), {"lo": 0.025, "hi": 0.975})
    pick = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c))).alias(f"{metric}_{c}")
    return edges.groupBy(*keys).agg(pick("r2", "lo"), pick("r2", "hi"), pick("mae", "lo"), pick("mae", "hi"))


def rank_models(table: DataFrame) -> DataFrame:
    """Rank by R2 inside each protocol."""
    return table.withColumn("rank", F.rank().over(Window.partitionBy("protocol").orderBy(F.desc("r2"))))


def rank_shift(table: DataFrame, first: str, second: str) -> DataFrame:
    ranked = rank_models(table)
    a = ranked.where(F.col("protocol") == first).select("model", F.col("rank").alias("rank_first"))
    b = ranked.where(F.col("protocol") == second).select("model", F.col("rank").alias("rank_second"))
    return a.join(b, "model").withColumn("shift", F.col("rank_second") - F.col("rank_first"))


# fixed values: the candidates named before any score was seen
DELIVERABLE = ("dist_road", "trees_v1", "trees_v2", "kernel", "hybrid", "hybrid_restricted")


def delivered_model(table: DataFrame, protocol: str, candidates: Sequence[str] = DELIVERABLE) -> DataFrame:
    """Best R2 among a list fixed beforehand; the first of the list wins a tie."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))
    return table.where((F.col("protocol") == protocol) & F.col("model").isin(*candidates)).agg(
        F.max_by("model", F.struct("r2", -place)).alias("model"), F.max("r2").alias("r2")
    )


def paired_gains(table: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Gain in R2 and MAE of the first over the second model of each pair, per protocol."""
    items = F.array(*[F.struct(F.lit(a).alias("model"), F.lit(b).alias("versus")) for a, b in pairs])
    named = table.select("protocol", F.col("model").alias("m"), "r2", "mae").withColumn("pair", F.explode(items))
    return named.where((F.col("m") == F.col("pair.model")) | (F.col("m") == F.col("pair.versus"))).groupBy(
        "protocol", F.col("pair.model").alias("model"), F.col("pair.versus").alias("versus")
    ).agg(
        (F.max(F.when(F.col("m") == F.col("pair.model"), F.col("r2"))) - F.max(F.when(F.col("m") == F.col("pair.versus"), F.col("r2")))).alias("gain_r2"),
        (F.max(F.when(F.col("m") == F.col("pair.versus"), F.col("mae"))) - F.max(F.when(F.col("m") == F.col("pair.model"), F.col("mae")))).alias("gain_mae_db"),
    ).where("gain_r2 is not null")


# --------------------------------------------------------------------------- noise ceiling

LEVEL_CHUNK_DB = 1.0


def noise_ceiling(df: DataFrame, bands: Sequence[float] = (20.0, 40.0, 60.0)) -> DataFrame:
    """Same-hour pairs nearer than each band: n, mean |difference|, sigma, best reachable R2.

    Pairs of measurements are never listed.  Pairs of *positions* are; each takes the levels of its greater position to
    its lesser one, where they are laid out with the levels there.  Running sums over that one order, for each band's
    neighbours, give counts of pairs and sums of |a - b|, and are added up by band before anything is shuffled again.
    """
    from soundfield.operators.lattice import positions_near

    widest = max(bands)
    lists = df.groupBy("hour", "x", "y", F.col("noise_db").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    spots = lists.select("hour", "x", "y").distinct()
    pairs = positions_near(spots, spots, widest, strict=True, match=["hour"])
    forward = (F.col("x") < F.col("x_r")) | ((F.col("x") == F.col("x_r")) & (F.col("y") < F.col("y_r")))
    # `far`: how many bands are too narrow for the pair; -1 for the position's own levels
    far = sum((F.when(F.col("d") < float(v), 0).otherwise(1) for v in bands), F.lit(0)).cast("byte")
    across = pairs.where(forward).select("hour", "x", "y", "x_r", "y_r", far.alias("far"))
    right = lists.select("hour", F.col("x").alias("x_r"), F.col("y").alias("y_r"), "v", "w")
    beside = across.join(right.hint("merge"), ["hour", "x_r", "y_r"]).select("hour", "x", "y", "far", "v", "w")
    own = lists.where("hour is not null and x is not null and y is not null").select("hour", "x", "y", F.lit(-1).cast("byte").alias("far"), "v", "w")
    chunk = F.floor(F.col("v") / LEVEL_CHUNK_DB).cast("bigint")
    key = ["hour", "x", "y"]
    # shuffled once, and before the columns of the running sums are made
    laid = own.unionByName(beside).withColumn("chunk", F.coalesce(chunk, F.lit(-(2 ** 62)))).repartition(*key, "chunk")
    widths = sorted(float(v) for v in bands)

    def reaches(i: int) -> Column:
        return (F.col("far") >= 0) & (F.col("far") <= i)

    masses = {"own": F.when(F.col("far") < 0, F.col("w")).otherwise(0.0)}
    masses |= {f"b{i}": F.when(reaches(i), F.col("w")).otherwise(0.0) for i in range(len(widths))}
    sums = {f"{p}_{n}": m * F.col("v") if p == "s" else m for n, m in masses.items() for p in "ws"}
    before = Window.partitionBy(*key, "chunk").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy(*key, "chunk").agg(*[F.sum(e).alias(n) for n, e in sums.items()]).select(
        *key, "chunk", *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"o_{n}") for n in sums]
    )
    inside = laid.select("*", *[F.coalesce(F.sum(e).over(before), F.lit(0.0)).alias(f"i_{n}") for n, e in sums.items()])
    merged = inside.join(offsets.hint("merge"), [*key, "chunk"])

    def below(n: str) -> Column:
        return F.col(f"i_{n}") + F.col(f"o_{n}")

    def parts(i: int) -> Column:
        w = F.when(F.col("far") < 0, below(f"w_b{i}")).when(reaches(i), below("w_own")).otherwise(0.0)
        s = F.when(F.col("far") < 0, below(f"s_b{i}")).when(reaches(i), below("s_own")).otherwise(0.0)
        return F.struct(F.lit(widths[i]).alias("band_m"), (F.col("w") * w).alias("pairs"), (F.col("w") * (F.col("v") * w - s)).alias("gap"))

    between = merged.select(F.explode(F.array(*[parts(i) for i in range(len(widths))])).alias("p")).select("p.*")
    here = running_totals(
        lists, ["hour", "x", "y"], chunk, [F.col("v")], {"w0": F.col("w"), "s0": F.col("w") * F.col("v")}
    ).groupBy("hour", "x", "y").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * (F.col("v") * F.col("w0") - F.col("s0"))).alias("gap")
    ).where("n > 1").select((F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), "gap")
    here = here.withColumn("band_m", F.explode(F.array(*[F.lit(v) for v in widths]))).where("band_m > 0")
    per_band = between.unionByName(here.select("band_m", "pairs", "gap")).groupBy("band_m").agg(
        F.sum("pairs").cast("bigint").alias("pairs"), F.sum("gap").alias("gap")
    ).where("pairs > 0")
    variance = df.agg(F.var_samp("noise_db").alias("var"))
    sigma = F.col("mean_abs_diff") * (math.sqrt(math.pi) / 2)
    return (
        with_scalars(per_band, variance).withColumn("mean_abs_diff", F.col("gap") / F.col("pairs")).withColumn("sigma", sigma)
        .select("band_m", "pairs", "mean_abs_diff", "sigma", (1.0 - F.col("sigma") * F.col("sigma") / F.col("var")).alias("ceiling_r2"))
    )
