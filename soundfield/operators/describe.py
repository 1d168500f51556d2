"""Descriptive tables of a measurement set: site, hour, ts, noise_db, class, dist_to_road."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions.numbers import correlation, rounded
from soundfield.functions import levels, survey
from soundfield.operators.quantiles import grouped_median, grouped_quantiles, summarise
from soundfield.operators.scans import attach, with_scalars


def _n() -> Column:
    return F.count(F.lit(1))


def describe(df: DataFrame, keys: Sequence[str], value: str = "noise_db") -> DataFrame:
    """n, mean, sd, min, quartiles, max of one column per group (or overall)."""
    v = F.col(value)
    return summarise(
        df.where(v.isNotNull()), keys,
        [_n().alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")],
        v, {"q1": 0.25, "median": 0.5, "q3": 0.75},
    )


def describe_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`describe` of several columns at once: one row per feature, one pass over the data."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(F.explode(entries).alias("e")).select("e.feature", "e.value")
    return describe(long, ["feature"], "value")


def hourly_median(df: DataFrame) -> DataFrame:
    return grouped_median(df, ["site", "hour"], F.col("noise_db"), "median_db")


def weekday_median(df: DataFrame) -> DataFrame:
    """Median by site and weekday (0 = Monday); all seven days, null where nothing was measured."""
    dated = df.withColumn("weekday", F.weekday("ts"))
    frame = df.select("site").distinct().withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return frame.join(grouped_median(dated, ["site", "weekday"], F.col("noise_db"), "median_db"), ["site", "weekday"], "left")


def hourly_quartiles(df: DataFrame) -> DataFrame:
    return summarise(df, ["hour"], [_n().alias("n")], F.col("noise_db"), {"q1": 0.25, "median": 0.5, "q3": 0.75})


def hourly_mean(df: DataFrame, at_least: int = 3) -> DataFrame:
    return df.groupBy("site", "hour").agg(_n().alias("n"), F.avg("noise_db").alias("mean_db")).where(F.col("n") >= at_least)


def _exceeds() -> Column:
    return F.col("noise_db") > levels.limit_for(F.col("hour"))


def exceedance_by_hour(df: DataFrame) -> DataFrame:
    return df.groupBy("hour").agg((100.0 * F.avg(_exceeds().cast("double"))).alias("pct_over"))


def exceedance_table(df: DataFrame) -> DataFrame:
    """Per site and period: n, median, share over the limit, mean excess of the rows over it."""
    rows = df.withColumn("period", levels.period(F.col("hour"))).withColumn("over", _exceeds())
    excess = F.col("noise_db") - levels.limit_for(F.col("hour"))
    return summarise(
        rows, ["site", "period"],
        [
            _n().alias("n"),
            (100.0 * F.avg(F.col("over").cast("double"))).alias("pct_over"),
            F.avg(F.when(F.col("over"), excess)).alias("mean_excess_db"),
        ],
        F.col("noise_db"), {"median_db": 0.5},
    )


def exceedance_overall(df: DataFrame) -> DataFrame:
    day = F.col("hour").between(6, 20)
    return df.agg(
        _n().alias("n"),
        (100.0 * F.avg(_exceeds().cast("double"))).alias("pct_over"),
        (100.0 * F.avg(F.when(day, (F.col("noise_db") > C.LIMIT_DAY).cast("double")))).alias("pct_over_day"),
    )


def peak_and_quiet_hour(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hours of the highest and lowest hourly median; the earlier hour wins a tie."""
    keys = list(keys)
    hourly = grouped_median(df, [*keys, "hour"], F.col("noise_db"), "m")
    return hourly.groupBy(*keys).agg(
        F.max_by("hour", F.struct("m", -F.col("hour"))).alias("peak_hour"), F.max("m").alias("peak_db"),
        F.min_by("hour", F.struct("m", "hour")).alias("quiet_hour"), F.min("m").alias("quiet_db"),
    )


def transport_vs_construction(df: DataFrame) -> DataFrame:
    """Median by kind of source, overall (site null) and per site."""
    kind = F.when(survey.is_construction(F.col("class")), "construction").otherwise("transport")
    rows = df.withColumn("kind", kind).withColumn("site", F.explode(F.array(F.lit(None).cast("string"), F.col("site"))))
    return summarise(rows, ["site", "kind"], [_n().alias("n")], F.col("noise_db"), {"median_db": 0.5})


def class_levels(df: DataFrame, at_least: int = 5) -> DataFrame:
    """Five numbers of each class with enough rows, quietest first; rows of the others are counted."""
    per = describe(df.where(F.col("class").isNotNull()), ["class"]).select("class", "n", "min", "q1", "median", "q3", "max")
    dropped = per.agg(F.coalesce(F.sum(F.when(F.col("n") < at_least, F.col("n"))), F.lit(0)).alias("rows_dropped"))
    return with_scalars(per.where(F.col("n") >= at_least), dropped).orderBy("median")


def class_ranking(df: DataFrame, top: int | None = None) -> DataFrame:
    """Mean level per class, loudest first."""
    ranked = df.groupBy("class").agg(_n().alias("n"), F.avg("noise_db").alias("mean_db")).orderBy(F.desc("mean_db"), "class")
    return ranked if top is None else ranked.limit(top)


def site_table(df: DataFrame) -> DataFrame:
    """Per site and for all sites: n, median, extremes, share below 60 dB, share at the roadside."""
    totals = df.rollup("site").agg(
        F.grouping("site").alias("__all"),
        _n().alias("n"), F.min("noise_db").alias("min_db"), F.max("noise_db").alias("max_db"),
        (100.0 * F.avg((F.col("noise_db") < 60).cast("double"))).alias("pct_below_60"),
        (100.0 * F.avg(survey.is_roadside(F.col("dist_to_road")).cast("double"))).alias("pct_roadside"),
    ).withColumn("site", F.when(F.col("__all") == 1, "All").otherwise(F.col("site"))).drop("__all")
    both = df.select("noise_db", F.explode(F.array(F.col("site"), F.lit("All"))).alias("site"))
    return attach(totals, grouped_median(both, ["site"], F.col("noise_db"), "median_db"), ["site"])


def campaign_headline(df: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    day = F.to_date("ts")
    head = summarise(
        df, [],
        [
            _n().alias("n"), F.countDistinct("site").alias("n_sites"),
            F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"),
            F.min("noise_db").alias("min_db"), F.max("noise_db").alias("max_db"),
            F.avg("noise_db").alias("mean_db"), F.stddev_samp("noise_db").alias("sd_db"),
            F.sum(levels.is_night(F.col("hour")).cast("int")).alias("n_night"),
            (100.0 * F.avg(survey.is_roadside(F.col("dist_to_road")).cast("double"))).alias("pct_roadside"),
            (100.0 * F.avg(F.when(F.col("hour").between(6, 20), (F.col("noise_db") > C.LIMIT_DAY).cast("double")))).alias("pct_over_day"),
        ],
        F.col("noise_db"), {"median_db": 0.5},
    )
    peak = peak_and_quiet_hour(df).select("peak_hour")
    return with_scalars(head, peak)


def break_comparison(df: DataFrame, break_day: str) -> DataFrame:
    """Mean level and median time (hours since the break) before and after a date."""
    start = F.lit(break_day).cast("timestamp_ntz")
    hours = F.timestamp_diff("MICROSECOND", start, F.col("ts")) / F.lit(3.6e9)
    rows = df.withColumn("part", F.when(F.col("ts") < start, "before").otherwise("after")).withColumn("h", hours)
    return summarise(rows, ["part"], [_n().alias("n"), F.avg("noise_db").alias("mean_db")], F.col("h"), {"median_h": 0.5})


def daily_means(df: DataFrame, break_day: str) -> DataFrame:
    start = F.lit(break_day).cast("timestamp_ntz")
    part = F.when(F.col("ts") < start, "before").otherwise("after")
    return df.groupBy(part.alias("part"), F.to_date("ts").alias("day")).agg(_n().alias("n"), F.avg("noise_db").alias("mean_db"))


def heat_cells(df: DataFrame, step: float = 0.001) -> DataFrame:
    """Mean level on a degree lattice, half-even rounding like numpy."""
    lat, lon = rounded(F.col("latitude") / step).cast("bigint"), rounded(F.col("longitude") / step).cast("bigint")
    return df.groupBy(lat.alias("lat_i"), lon.alias("lon_i")).agg(_n().alias("n"), F.avg("noise_db").alias("mean_db")).select(
        (F.col("lat_i") * step).alias("lat"), (F.col("lon_i") * step).alias("lon"), "n", "mean_db"
    )


def rasterise(df: DataFrame, step: float = C.GRID_STEP_M, value: str = "noise_db") -> DataFrame:
    """Mean value per lattice node of each site, counted from the site's lowest corner."""
    corner = df.groupBy("site").agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"))
    placed = attach(df, corner, ["site"])
    ix = rounded((F.col("x") - F.col("__x0")) / step).cast("bigint")
    iy = rounded((F.col("y") - F.col("__y0")) / step).cast("bigint")
    return placed.groupBy("site", ix.alias("ix"), iy.alias("iy")).agg(_n().alias("n"), F.avg(value).alias("mean_value"))


def rasterise_degrees(df: DataFrame, step: float = C.GRID_STEP_M, value: str = "level_db") -> DataFrame:
    """As `rasterise` for longitude/latitude input, with metres per degree at the site's mean latitude."""
    where = df.groupBy("site").agg(
        F.avg("latitude").alias("__m"), F.min("longitude").alias("__o"), F.min("latitude").alias("__a")
    )
    placed = attach(df, where, ["site"])
    x = (F.col("longitude") - F.col("__o")) * 111320.0 * F.cos(F.radians("__m"))
    y = (F.col("latitude") - F.col("__a")) * 110540.0
    return placed.groupBy(
        "site", rounded(x / step).cast("bigint").alias("ix"), rounded(y / step).cast("bigint").alias("iy")
    ).agg(_n().alias("n"), F.avg(value).alias("mean_value"))


def histogram(df: DataFrame, value: Column, low: float, high: float, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in fixed bins [low + i*width, ...); the last bin includes `high`.

    `density` divides by n * width, per key group.
    """
    keys = list(keys)
    last = round((high - low) / width) - 1
    i = F.least(F.floor((value - low) / width), F.lit(last)).cast("int")
    rows = df.where(value.between(low, high)).groupBy(*keys, i.alias("bin")).agg(_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("bin_low", low + F.col("bin") * width).withColumn("density", F.col("n") / (total * width))


def equal_bins(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Histogram over the observed range cut into equal bins, `density` per key group."""
    keys = list(keys)
    span = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    placed = with_scalars(df.where(F.col(value).isNotNull()).select(*keys, value), span)
    width = (F.col("__hi") - F.col("__lo")) / bins
    i = F.least(F.floor((F.col(value) - F.col("__lo")) / F.when(width > 0, width)), F.lit(bins - 1))
    rows = placed.groupBy(*keys, F.coalesce(i, F.lit(0)).cast("int").alias("bin"), "__lo", "__hi").agg(_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("bin_low", F.col("__lo") + F.col("bin") * width).withColumn(
        "density", F.col("n") / (total * F.when(width > 0, width))
    ).drop("__lo", "__hi")


def hour_band(hour: Column) -> Column:
    return (
        F.when((hour > 4) & (hour <= 8), "5-8h").when((hour > 8) & (hour <= 12), "9-12h")
        .when((hour > 12) & (hour <= 16), "13-16h").when((hour > 16) & (hour <= 22), "17-21h")
    )


def error_by_hour_band(df: DataFrame, error: str = "error") -> DataFrame:
    rows = df.withColumn("hour_band", hour_band(F.col("hour"))).where("hour_band is not null")
    return describe(rows, ["hour_band"], error).select("hour_band", "n", "min", "q1", "median", "q3", "max")


def strata_stats(df: DataFrame, major_sites: Sequence[str] = C.MAJOR_SITES) -> DataFrame:
    """n, median, mean, p90, sd of each (overlapping) stratum."""
    names = survey.strata(F.col("hour"), F.col("dist_to_road"), F.col("site"), major_sites)
    rows = df.select("noise_db", F.explode(names).alias("stratum"))
    return summarise(
        rows, ["stratum"],
        [_n().alias("n"), F.avg("noise_db").alias("mean_db"), F.stddev_samp("noise_db").alias("sd_db")],
        F.col("noise_db"), {"median_db": 0.5, "p90_db": 0.9},
    )


def anchor_gaps(anchors: DataFrame, strata: DataFrame) -> DataFrame:
    """Published anchors against our strata: raw gap and gap corrected for the metric."""
    own = strata.select(F.col("stratum").alias("comparable"), F.col("n").alias("our_n"), F.col("median_db").alias("our_median_db"))
    joined = anchors.join(own, "comparable", "left").withColumn("our_n", F.coalesce("our_n", F.lit(0)))
    raw = F.col("value") - F.col("our_median_db")
    return joined.withColumn("gap_raw_db", rounded(raw, 1)).withColumn(
        "gap_corrected_db", rounded(raw - F.col("metric_gap_db"), 1)
    )


def bias_interval(gaps: DataFrame) -> DataFrame:
    usable = gaps.where((F.col("status") != "grey") & F.col("gap_corrected_db").isNotNull() & (F.col("comparable") != "night_all"))
    return usable.agg(F.min("gap_corrected_db").alias("low_db"), F.max("gap_corrected_db").alias("high_db"))


def heat_normalised(df: DataFrame, value: str = "noise_db", low: float = 0.02, high: float = 0.98, keys: Sequence[str] = ()) -> DataFrame:
    """Adds `heat`: the value stretched between two of its quantiles, clipped to 0..1."""
    keys = list(keys)
    edges = grouped_quantiles(df, keys, F.col(value), {"__q_lo": low, "__q_hi": high})
    if keys:
        joined = attach(df, edges, keys)
    else:
        joined = with_scalars(df, edges)
    return joined.withColumn("heat", levels.heat_scale(F.col(value), F.col("__q_lo"), F.col("__q_hi"))).drop("__q_lo", "__q_hi")


def rain_effect(df: DataFrame, at_least: int = 3) -> DataFrame:
    """Median wet minus median dry, averaged over (day, site) sessions with enough of both."""
    rows = df.where(F.col("precipitation").isNotNull()).select(
        F.to_date("ts").alias("day"), "site", (F.col("precipitation") > 0).alias("rain"), "noise_db"
    )
    med = summarise(rows, ["day", "site", "rain"], [_n().alias("n")], F.col("noise_db"), {"m": 0.5})
    sessions = med.groupBy("day", "site").agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("states"),
        (F.max(F.when(F.col("rain"), F.col("m"))) - F.max(F.when(~F.col("rain"), F.col("m")))).alias("diff_db"),
    ).where((F.col("states") == 2) & (F.col("least") >= at_least))
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.avg("diff_db").alias("rain_effect_db"))


def partial_correlations(df: DataFrame, columns: Sequence[str], level: str = "noise_db", hour: str = "hour") -> DataFrame:
    """Raw correlation with the level, and after removing a quadratic in the hour from both.

    Sums of powers come from one pass; the two residual vectors never exist:
    with z = (1, h, h^2), cov(res u, res v) = Suv - Szu' Szz^-1 Szv.  Hours are
    centred and scaled first, which leaves the fits unchanged.
    """
    have = df
    for c in columns:
        have = have.where(F.col(c).isNotNull())
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("v")) for c in columns])
    long = have.select(((F.col(hour) - 12.0) / 12.0).alias("h"), F.col(level).alias("u0"), F.explode(pairs).alias("p"))
    long = long.select("h", "u0", "p.factor", F.col("p.v").alias("v0"))
    centre = long.groupBy("factor").agg(F.avg("u0").alias("__mu"), F.avg("v0").alias("__mv"))
    long = long.join(centre, "factor").select(
        "factor", "h", (F.col("u0") - F.col("__mu")).alias("u"), (F.col("v0") - F.col("__mv")).alias("v")
    )
    h, u, v = F.col("h"), F.col("u"), F.col("v")
    s = long.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n"), correlation("u", "v").alias("r_raw"),
        *[F.sum(F.pow(h, k)).alias(f"h{k}") for k in (1, 2, 3, 4)],
        *[F.sum(F.pow(h, k) * u).alias(f"u{k}") for k in (0, 1, 2)],
        *[F.sum(F.pow(h, k) * v).alias(f"v{k}") for k in (0, 1, 2)],
        F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
    )
    n, h1, h2, h3, h4 = (F.col(c) for c in ("n", "h1", "h2", "h3", "h4"))
    # adjugate of the symmetric 3 x 3 moment matrix
    c00, c01, c02 = h2 * h4 - h3 * h3, h2 * h3 - h1 * h4, h1 * h3 - h2 * h2
    c11, c12, c22 = n * h4 - h2 * h2, h1 * h2 - n * h3, n * h2 - h1 * h1
    det = n * c00 + h1 * c01 + h2 * c02

    def quad(a: str, b: str) -> Column:
        a0, a1, a2 = (F.col(f"{a}{k}") for k in (0, 1, 2))
        b0, b1, b2 = (F.col(f"{b}{k}") for k in (0, 1, 2))
        top = (
            a0 * (c00 * b0 + c01 * b1 + c02 * b2) + a1 * (c01 * b0 + c11 * b1 + c12 * b2)
            + a2 * (c02 * b0 + c12 * b1 + c22 * b2)
        )
        return top / F.when(det != 0, det)

    ruv = F.col("uv") - quad("u", "v")
    ruu, rvv = F.col("uu") - quad("u", "u"), F.col("vv") - quad("v", "v")
    return s.select("factor", "n", "r_raw", (ruv / F.sqrt(F.when(ruu * rvv > 0, ruu * rvv))).alias("r_partial"))


def correlations(df: DataFrame, level: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of the level with each column, per key and over all (key null)."""
    aggs = [correlation(level, c).alias(f"r_{c}") for c in columns]
    if not keys:
        return df.agg(_n().alias("n"), *aggs)
    return df.rollup(*keys).agg(_n().alias("n"), *aggs)


def domain_overlap(df: DataFrame, city: str, feature: str) -> DataFrame:
    return grouped_quantiles(df, [city], F.col(feature), {"p05": 0.05, "p95": 0.95})


def bounded_sample(df: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """A repeatable random sample: the `size` rows with the smallest keyed hash."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(size)
