"""Queries over the cleaned measurements: cleaning, levels, descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundfield.functions import geo, levels, survey, timing
from soundfield.operators import cleaning, describe, energy
from soundfield.plans.registry import query
from soundfield.plans.tables import CENTRES, MAJOR, Tables, oracle

_NEAR = "class like '%Construction%'"


@query("exceedance_table", oracle(
    """select site, period, count(*) as n, median(noise_db) as median_db, 100e0 * avg(case when noise_db > lim then 1e0 else 0e0 end) as pct_over,
       avg(case when noise_db > lim then noise_db - lim end) as mean_excess_db from p group by 1, 2""",
    "median_db pct_over mean_excess_db",
    p="select *, case when hour >= 21 or hour < 6 then 'night' else 'day' end as period, case when hour >= 21 or hour < 6 then 55 else 70 end as lim from meas"))
def exceedance_table(t: Tables):
    return describe.exceedance_table(t.meas)


@query("clean_measurements", oracle(
    "select obs_id, who, site, hour, is_weekend, day_of_week, noise_db from meas", "noise_db"))
def clean_measurements(t: Tables):
    return t.meas.select("obs_id", "who", "site", "hour", "is_weekend", "day_of_week", "noise_db")


@query("strict_clean", oracle(
    """select obs_id, noise_db from (select *, row_number() over (partition by coalesce(nullif(trim(contributor_id), ''), collector), date_trunc('hour', ts) order by seq) as rn from obs)
       where rn = 1 and accuracy < 50 and noise_db between 20 and 120""", "noise_db"))
def strict_clean(t: Tables):
    rows = cleaning.clean(
        t.obs, time="ts", position=("x", "y"), dedup_time=F.date_trunc("hour", "ts"), offsets={}, strict=True
    )
    return rows.select("obs_id", "noise_db")


@query("site_corrections", oracle("select obs_id, site_declared, site, noise_db from meas where site_declared <> site", "noise_db"))
def site_corrections(t: Tables):
    return cleaning.site_corrections(t.meas).select("obs_id", "site_declared", "site", "noise_db")


@query("published_rows", oracle(
    "select latitude, longitude, noise_db, cast(epoch_us(ts) as bigint) as ts_us, class, site, hour, is_weekend, dist_to_road from located",
    "latitude longitude noise_db"))
def published_rows(t: Tables):
    rows = cleaning.published(t.located.withColumn("timestamp", F.col("ts")))
    return rows.withColumn("ts_us", F.unix_micros(F.col("timestamp").cast("timestamp"))).drop("timestamp")


@query("standardized_survey", oracle(
    """select seq, round(21 + (seq % 1000) / 1e4, 6) as latitude, noise_db, lower(trim(collector)) as collector,
         coalesce(case band when 'd_0_2' then '0-2 m' when 'd_2_10' then '2-10 m' when 'd_10_30' then '10-30 m' when 'd_30_60' then '30-60 m' when 'd_60plus' then '> 60 m' end, band) as dist_to_road,
         'horizontal' as phone_orientation, case when class like '%Construction%' then 'yes' else 'no' end as construction_nearby,
         case when seq % 3 = 0 then null else cast(seq % 50 as double) end as count_cars,
         cast(epoch_us(date_trunc('second', ts) + interval 7 hour) as bigint) as local_us
       from s""", "latitude noise_db count_cars",
    s="select *, case dist_to_road when '0-2 m' then 'd_0_2' when '2-10 m' then 'd_2_10' when '10-30 m' then 'd_10_30' when '30-60 m' then 'd_30_60' when '> 60 m' then 'd_60plus' end as band from obs"))
def standardized_survey(t: Tables):
    bands = {"0-2 m": "d_0_2", "2-10 m": "d_2_10", "10-30 m": "d_10_30", "30-60 m": "d_30_60", "> 60 m": "d_60plus"}
    text = t.obs.select(
        "seq", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("timestamp"),
        F.format_string("%.4f", 21 + (F.col("seq") % 1000) / 10000.0).alias("latitude"), F.lit("105.85").alias("longitude"),
        F.lit(None).cast("string").alias("altitude"), F.col("accuracy").cast("string").alias("accuracy"),
        F.col("noise_db").cast("string").alias("noise_db"), "class",
        F.concat(F.lit(" "), F.upper("collector"), F.lit(" ")).alias("collector"),
        survey.recode(F.col("dist_to_road"), bands).alias("dist_to_road"),
        F.when(F.col("seq") % 3 == 0, "many").otherwise((F.col("seq") % 50).cast("string")).alias("count_cars"),
    )
    typed = cleaning.standardize(text)
    return typed.select(
        "seq", "latitude", "noise_db", "collector", "dist_to_road", "phone_orientation", "construction_nearby", "count_cars",
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("local_us"),
    )


@query("survey_violations", oracle(
    """select obs_id, problem from (select obs_id, unnest(list_filter([
         case when accuracy is null then 'accuracy:required' end,
         case when accuracy > 90 then 'accuracy:range' end,
         case when noise_db < 30 or noise_db > 110 then 'noise_db:range' end,
         case when class not in ('click', 'view', 'Construction noise', 'purchase') then 'class:choice' end,
         case when contributor_id is null or trim(contributor_id) = '' then 'contributor_id:required' end], lambda v: v is not null)) as problem from obs)"""))
def survey_violations(t: Tables):
    rules = [
        survey.Rule("accuracy", "integer", required=True, low=0, high=90),
        survey.Rule("noise_db", "decimal", low=30, high=110),
        survey.Rule("class", "choice", choices=("click", "view", "Construction noise", "purchase")),
        survey.Rule("contributor_id", required=True),
    ]
    return t.obs.select("obs_id", F.explode(survey.violations(rules)).alias("problem"))


@query("calendar_features", oracle(
    "select obs_id, sin(hour * 2 * pi() / 24) as hour_sin, cos(hour * 2 * pi() / 24) as hour_cos, is_weekend from meas", "hour_sin hour_cos"))
def calendar_features(t: Tables):
    return t.meas.select(
        "obs_id", timing.hour_sin(F.col("hour")).alias("hour_sin"), timing.hour_cos(F.col("hour")).alias("hour_cos"), "is_weekend"
    )


@query("level_bands", oracle(
    """select period, field_band, legend_band, zone_band, count(*) as n from (select case when hour >= 22 or hour < 6 then 'night' else 'day' end as period,
        (noise_db >= 60)::int + (noise_db >= 70)::int + (noise_db >= 80)::int as field_band,
        (noise_db >= 50)::int + (noise_db >= 55)::int + (noise_db >= 60)::int + (noise_db >= 65)::int + (noise_db >= 70)::int + (noise_db >= 75)::int + (noise_db >= 80)::int as legend_band,
        (noise_db >= 60)::int + (noise_db >= 65)::int + (noise_db >= 70)::int + (noise_db >= 75)::int as zone_band from meas) group by all"""))
def level_bands(t: Tables):
    v = F.col("noise_db")
    return t.meas.groupBy(
        levels.period(F.col("hour"), 22, 6).alias("period"), levels.band(v, levels.FIELD_MAP_EDGES).alias("field_band"),
        levels.band(v, levels.LEGEND_EDGES).alias("legend_band"), levels.band(v, levels.ZONE_EDGES).alias("zone_band"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("describe_by_site", oracle(
    """select site, count(*) as n, avg(noise_db) as mean, stddev_samp(noise_db) as sd, min(noise_db) as min, max(noise_db) as max,
       quantile_cont(noise_db, 0.25) as q1, median(noise_db) as median, quantile_cont(noise_db, 0.75) as q3 from meas group by site""",
    "mean sd min max q1 median q3"))
def describe_by_site(t: Tables):
    return describe.describe(t.meas, ["site"])


@query("describe_columns", oracle(
    """select feature, count(v) as n, avg(v) as mean, stddev_samp(v) as sd, min(v) as min, max(v) as max,
       quantile_cont(v, 0.25) as q1, median(v) as median, quantile_cont(v, 0.75) as q3 from l where v is not null group by feature""",
    "mean sd min max q1 median q3",
    l="select 'noise_db' as feature, noise_db as v from meas union all select 'accuracy', cast(accuracy as double) from meas union all select 'hour', cast(hour as double) from meas"))
def describe_columns(t: Tables):
    return describe.describe_features(t.meas, ["noise_db", "accuracy", "hour"])


@query("hourly_median_by_site", oracle("select site, hour, median(noise_db) as median_db from meas group by 1, 2", "median_db"))
def hourly_median_by_site(t: Tables):
    return describe.hourly_median(t.meas)


@query("weekday_median_by_site", oracle(
    """select s.site, d.weekday, m.median_db from (select distinct site from meas) s cross join (select unnest([0,1,2,3,4,5,6]) as weekday) d
       left join (select site, cast(extract(isodow from ts) as int) - 1 as weekday, median(noise_db) as median_db from meas group by 1, 2) m
       on m.site = s.site and m.weekday = d.weekday""", "median_db"))
def weekday_median_by_site(t: Tables):
    return describe.weekday_median(t.meas)


@query("hourly_quartiles", oracle(
    "select hour, count(*) as n, quantile_cont(noise_db, 0.25) as q1, median(noise_db) as median, quantile_cont(noise_db, 0.75) as q3 from meas group by 1",
    "q1 median q3"))
def hourly_quartiles(t: Tables):
    return describe.hourly_quartiles(t.meas)


@query("hourly_mean_enough", oracle(
    "select site, hour, count(*) as n, avg(noise_db) as mean_db from meas group by 1, 2 having count(*) >= 3", "mean_db"))
def hourly_mean_enough(t: Tables):
    return describe.hourly_mean(t.meas)


@query("exceedance_by_hour", oracle(
    "select hour, 100e0 * avg(case when noise_db > case when hour >= 21 or hour < 6 then 55 else 70 end then 1e0 else 0e0 end) as pct_over from meas group by 1",
    "pct_over"))
def exceedance_by_hour(t: Tables):
    return describe.exceedance_by_hour(t.meas)


@query("exceedance_overall", oracle(
    """select count(*) as n, 100e0 * avg(case when noise_db > case when hour >= 21 or hour < 6 then 55 else 70 end then 1e0 else 0e0 end) as pct_over,
       100e0 * avg(case when hour between 6 and 20 then case when noise_db > 70 then 1e0 else 0e0 end end) as pct_over_day from meas""", "pct_over pct_over_day"))
def exceedance_overall(t: Tables):
    return describe.exceedance_overall(t.meas)


_HOURLY = "select site, hour, median(noise_db) as m from meas group by 1, 2"


@query("peak_and_quiet_hour", oracle(
    """select site, (array_agg(hour order by m desc, hour))[1] as peak_hour, max(m) as peak_db,
       (array_agg(hour order by m, hour))[1] as quiet_hour, min(m) as quiet_db from h group by site""", "peak_db quiet_db", h=_HOURLY))
def peak_and_quiet_hour(t: Tables):
    return describe.peak_and_quiet_hour(t.meas, ["site"])


@query("transport_vs_construction", oracle(
    """select site, kind, count(*) as n, median(noise_db) as median_db from (
       select site, case when class like '%Construction%' then 'construction' else 'transport' end as kind, noise_db from meas
       union all select null, case when class like '%Construction%' then 'construction' else 'transport' end, noise_db from meas) group by 1, 2""", "median_db"))
def transport_vs_construction(t: Tables):
    return describe.transport_vs_construction(t.meas)


@query("class_levels", oracle(
    """select class, n, min, q1, median, q3, max, (select cast(coalesce(sum(n), 0) as bigint) from c where n < 5) as rows_dropped from c where n >= 5""",
    "min q1 median q3 max",
    c="""select class, count(*) as n, min(noise_db) as min, quantile_cont(noise_db, 0.25) as q1, median(noise_db) as median,
         quantile_cont(noise_db, 0.75) as q3, max(noise_db) as max from meas where class is not null group by class"""))
def class_levels(t: Tables):
    return describe.class_levels(t.meas)


@query("class_ranking", oracle("select class, count(*) as n, avg(noise_db) as mean_db from meas group by 1", "mean_db"))
def class_ranking(t: Tables):
    return describe.class_ranking(t.meas)


@query("loudest_rows", oracle("select obs_id, noise_db from meas order by noise_db desc, obs_id limit 20", "noise_db"))
def loudest_rows(t: Tables):
    return t.meas.select("obs_id", "noise_db").orderBy(F.desc("noise_db"), "obs_id").limit(20)


@query("bounded_sample", oracle("select obs_id, noise_db from meas order by md5('0:' || cast(obs_id as string)), obs_id limit 500", "noise_db"))
def bounded_sample(t: Tables):
    return describe.bounded_sample(t.meas.select("obs_id", "noise_db"), 500, "obs_id")


@query("site_table", oracle(
    """select coalesce(site, 'All') as site, count(*) as n, min(noise_db) as min_db, max(noise_db) as max_db,
       100e0 * avg(case when noise_db < 60 then 1e0 else 0e0 end) as pct_below_60,
       100e0 * avg(case when dist_to_road in ('0-2 m', '2-10 m') then 1e0 else 0e0 end) as pct_roadside, median(noise_db) as median_db
       from meas group by rollup(site)""", "min_db max_db pct_below_60 pct_roadside median_db"))
def site_table(t: Tables):
    return describe.site_table(t.meas)


@query("campaign_headline", oracle(
    """select count(*) as n, count(distinct site) as n_sites, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day,
       min(noise_db) as min_db, max(noise_db) as max_db, avg(noise_db) as mean_db, stddev_samp(noise_db) as sd_db,
       cast(sum(case when hour >= 21 or hour < 6 then 1 else 0 end) as bigint) as n_night,
       100e0 * avg(case when dist_to_road in ('0-2 m', '2-10 m') then 1e0 else 0e0 end) as pct_roadside,
       100e0 * avg(case when hour between 6 and 20 then case when noise_db > 70 then 1e0 else 0e0 end end) as pct_over_day,
       median(noise_db) as median_db, (select (array_agg(hour order by m desc, hour))[1] from h) as peak_hour from meas""",
    "min_db max_db mean_db sd_db pct_roadside pct_over_day median_db",
    h="select hour, median(noise_db) as m from meas group by 1"))
def campaign_headline(t: Tables):
    return describe.campaign_headline(t.meas)


@query("break_comparison", oracle(
    """select case when ts < timestamp '2024-01-16' then 'before' else 'after' end as part, count(*) as n, avg(noise_db) as mean_db,
       median(date_diff('microsecond', timestamp '2024-01-16', ts) / 3.6e9) as median_h from meas group by 1""", "mean_db median_h"))
def break_comparison(t: Tables):
    return describe.break_comparison(t.meas, "2024-01-16")


@query("daily_means", oracle(
    """select case when ts < timestamp '2024-01-16' then 'before' else 'after' end as part, strftime(ts, '%Y-%m-%d') as day, count(*) as n, avg(noise_db) as mean_db
       from meas group by 1, 2""", "mean_db"))
def daily_means(t: Tables):
    return describe.daily_means(t.meas, "2024-01-16").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("heat_cells", oracle(
    """select lat_i * 0.001e0 as lat, lon_i * 0.001e0 as lon, count(*) as n, avg(noise_db) as mean_db from
       (select cast(round_even(latitude / 0.001e0, 0) as bigint) as lat_i, cast(round_even(longitude / 0.001e0, 0) as bigint) as lon_i, noise_db from located)
       group by lat_i, lon_i""", "lat lon mean_db"))
def heat_cells(t: Tables):
    return describe.heat_cells(t.located)


@query("lattice_raster", oracle(
    """select m.site, cast(round_even((x - x0) / 40, 0) as bigint) as ix, cast(round_even((y - y0) / 40, 0) as bigint) as iy, count(*) as n, avg(noise_db) as mean_value
       from meas m join (select site, min(x) as x0, min(y) as y0 from meas group by site) c on c.site = m.site group by 1, 2, 3""", "mean_value"))
def lattice_raster(t: Tables):
    return describe.rasterise(t.meas)


@query("level_histogram", oracle(
    """select bin, n, 20 + bin * 2.5e0 as bin_low, n / (sum(n) over () * 2.5e0) as density from
       (select cast(least(floor((noise_db - 20) / 2.5e0), 39) as int) as bin, count(*) as n from meas where noise_db between 20 and 120 group by 1)""", "bin_low density"))
def level_histogram(t: Tables):
    return describe.histogram(t.meas, F.col("noise_db"), 20.0, 120.0, 2.5)


@query("density_by_period", oracle(
    """select period, bin, n, lo + bin * ((hi - lo) / 35) as bin_low, n / (sum(n) over (partition by period) * ((hi - lo) / 35)) as density from
       (select period, cast(least(floor((noise_db - lo) / ((hi - lo) / 35)), 34) as int) as bin, lo, hi, count(*) as n from
         (select case when hour >= 21 or hour < 6 then 'night' else 'day' end as period, noise_db from meas), (select min(noise_db) as lo, max(noise_db) as hi from meas)
         group by all)""", "bin_low density"))
def density_by_period(t: Tables):
    return describe.equal_bins(t.meas.withColumn("period", levels.period(F.col("hour"))), "noise_db", 35, ["period"])


_STRATA = """select 'all' as stratum, noise_db from meas
 union all select 'roadside_day', noise_db from meas where hour >= 6 and hour < 21 and dist_to_road in ('0-2 m', '2-10 m')
 union all select 'roadside_day_major', noise_db from meas where hour >= 6 and hour < 21 and dist_to_road in ('0-2 m', '2-10 m') and site in ('site0', 'site1')
 union all select 'night_all', noise_db from meas where not (hour >= 6 and hour < 21)"""
_STATS = """select stratum, count(*) as n, avg(noise_db) as mean_db, stddev_samp(noise_db) as sd_db, median(noise_db) as median_db,
 quantile_cont(noise_db, 0.9) as p90_db from strata_rows group by stratum"""


@query("strata_stats", oracle("select * from st", "mean_db sd_db median_db p90_db", strata_rows=_STRATA, st=_STATS))
def strata_stats(t: Tables):
    return describe.strata_stats(t.meas, MAJOR)


# anchor-like rows derived from the region table: one stratum per row
_ANCHORS = """select r_name as source, 60e0 + 4 * r_regionkey as value, case r_regionkey when 0 then 'all' when 1 then 'roadside_day' when 2 then 'roadside_day_major' when 3 then 'night_all' else 'roadside_day' end as comparable,
 0.5e0 * r_regionkey as metric_gap_db, case when r_regionkey = 4 then 'grey' else 'checked' end as status from region"""


def _anchors(t: Tables):
    t.raw("region").createOrReplaceTempView("region")
    return t.spark.sql(_ANCHORS)


@query("anchor_gaps", oracle(
    """select source, comparable, value, status, st.n as our_n, median_db as our_median_db, round(value - median_db, 1) as gap_raw_db,
       round(value - median_db - metric_gap_db, 1) as gap_corrected_db, metric_gap_db from anchors a left join st on st.stratum = a.comparable""",
    "our_median_db gap_raw_db gap_corrected_db", strata_rows=_STRATA, st=_STATS, anchors=_ANCHORS))
def anchor_gaps(t: Tables):
    return describe.anchor_gaps(_anchors(t), describe.strata_stats(t.meas, MAJOR))


@query("bias_interval", oracle(
    """select min(g) as low_db, max(g) as high_db from (select round(value - median_db - metric_gap_db, 1) as g from anchors a join st on st.stratum = a.comparable
       where status <> 'grey' and comparable <> 'night_all')""", "low_db high_db", strata_rows=_STRATA, st=_STATS, anchors=_ANCHORS))
def bias_interval(t: Tables):
    return describe.bias_interval(describe.anchor_gaps(_anchors(t), describe.strata_stats(t.meas, MAJOR)))


@query("heat_normalised", oracle(
    """select obs_id, least(greatest((noise_db - lo) / (case when hi - lo <> 0 then hi - lo else 1 end), 0), 1) as heat from meas,
       (select quantile_cont(noise_db, 0.02) as lo, quantile_cont(noise_db, 0.98) as hi from meas) q""", "heat"))
def heat_normalised(t: Tables):
    return describe.heat_normalised(t.meas).select("obs_id", "heat")


@query("weather_join", oracle(
    """select obs_id, temperature_2m, wind_speed_10m, precipitation from meas m left join weather w on w.site = m.site and w.hour_i = cast(floor(ts_us / 3600000000) as bigint)""",
    "temperature_2m wind_speed_10m precipitation"))
def weather_join(t: Tables):
    return _with_weather(t).select("obs_id", "temperature_2m", "wind_speed_10m", "precipitation")


def _with_weather(t: Tables):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hourly = t.weather.select(
        "site", (start + F.make_dt_interval(F.lit(0), F.col("hour_i").cast("int"))).alias("time_h"),
        "temperature_2m", "wind_speed_10m", "precipitation",
    )
    return cleaning.join_weather(t.meas, hourly, time="ts")


_WET = "select m.*, temperature_2m, wind_speed_10m, precipitation from meas m left join weather w on w.site = m.site and w.hour_i = cast(floor(ts_us / 3600000000) as bigint)"


@query("rain_effect", oracle(
    """select count(*) as sessions, avg(d) as rain_effect_db from (
       select max(case when rain then m end) - max(case when not rain then m end) as d from
        (select cast(ts as date) as day, site, precipitation > 0 as rain, count(*) as n, median(noise_db) as m from wet where precipitation is not null group by 1, 2, 3)
       group by day, site having count(*) = 2 and min(n) >= 3)""", "rain_effect_db", wet=_WET))
def rain_effect(t: Tables):
    return describe.rain_effect(_with_weather(t))


def _partial_oracle() -> str:
    fits = []
    for factor in ("temperature_2m", "wind_speed_10m", "precipitation"):
        fits.append(f"select '{factor}' as factor, (hour - 12) / 12e0 as h, noise_db as u, {factor} as v from wet where temperature_2m is not null and wind_speed_10m is not null and precipitation is not null")
    # orthogonal polynomials in the hour: 1, h - mean, then h^2 with both projected out
    return oracle(
        """select factor, count(*) as n, corr(u, v) as r_raw, corr(u - au * e1 - bu * e2, v - av * e1 - bv * e2) as r_partial from
           (select *, sum(u * e1) over w / sum(e1 * e1) over w as au, sum(u * e2) over w / sum(e2 * e2) over w as bu,
                   sum(v * e1) over w / sum(e1 * e1) over w as av, sum(v * e2) over w / sum(e2 * e2) over w as bv from p2 window w as (partition by factor))
           group by factor""",
        "r_raw r_partial", wet=_WET, long_rows=" union all ".join(fits),
        p1="select *, h - avg(h) over (partition by factor) as e1 from long_rows",
        p2="""select *, h * h - avg(h * h) over w - e1 * (sum(h * h * e1) over w / sum(e1 * e1) over w) as e2 from p1 window w as (partition by factor)""")


@query("partial_correlations", _partial_oracle())
def partial_correlations(t: Tables):
    return describe.partial_correlations(_with_weather(t), ["temperature_2m", "wind_speed_10m", "precipitation"])


@query("equivalent_levels", oracle(
    "select who, hour, is_weekend, count(*) as n, 10 * log10(avg(pow(10e0, noise_db / 10))) as laeq_db from meas group by 1, 2, 3 having count(*) >= 3", "laeq_db"))
def equivalent_levels(t: Tables):
    return energy.equivalent_levels(t.meas, ["who", "hour", "is_weekend"], at_least=3)


@query("merged_levels", oracle(
    "select site, hour, is_weekend, count(*) as n, 10 * log10(avg(pow(10e0, noise_db / 10))) as laeq_db from meas group by 1, 2, 3 having count(*) >= 20", "laeq_db"))
def merged_levels(t: Tables):
    """Daily part sums merged by row count give the same levels as one pass."""
    partials = energy.leq_partials(t.meas, ["site", "hour", "is_weekend"], F.to_date("ts"))
    return energy.merge_leq(partials, ["site", "hour", "is_weekend"], at_least=20)


@query("construction_excess", oracle(
    """select hours, case when e > 0 then 10 * log10(e) end as excess_db, sign(e) * 10 * log10(abs(e)) as signed_db from (select count(*) as hours, median(e1 - e0) as e from (
       select hour, avg(case when near then e end) as e1, avg(case when not near then e end) as e0 from (select hour, class like '%Construction%' as near, pow(10e0, noise_db / 10) as e from meas)
       group by hour having count(*) filter (near) >= 2 and count(*) filter (not near) >= 2))""", "excess_db signed_db"))
def construction_excess(t: Tables):
    got = energy.construction_excess(t.meas, survey.is_construction(F.col("class")))
    e = F.col("excess_energy")
    return got.select("hours", "excess_db", (F.signum(e) * 10 * F.log10(F.abs(e))).alias("signed_db"))


@query("construction_source", oracle(
    """select mw as median_with_db, mo as median_without_db, src as source_db, d as distance_m,
        10 * log10(pow(10e0, mo / 10) + coalesce(pow(10e0, (src - 20 * log10(d / 56e0)) / 10), 0)) as total_db from
       (select mw, mo, case when pow(10e0, mw / 10) > pow(10e0, mo / 10) then 10 * log10(pow(10e0, mw / 10) - pow(10e0, mo / 10)) end as src from
        (select median(noise_db) filter (class like '%Construction%') as mw, median(noise_db) filter (not class like '%Construction%') as mo from meas)) a,
       (select unnest([25e0, 56e0, 200e0]) as d) b""", "median_with_db median_without_db source_db total_db"))
def construction_source(t: Tables):
    return energy.construction_source(t.meas, survey.is_construction(F.col("class")))


@query("phone_calibration", oracle(
    """select device, 0.5e0 + avg(ref - noise_db) as offset_db, count(*) as attempts, coalesce(stddev_samp(ref - noise_db), 0) as spread_db,
       count(*) >= 2 and coalesce(stddev_samp(ref - noise_db), 0) <= 1 as agrees
       from (select who as device, noise_db, noise_db + 1 + (obs_id % 5) * 0.4e0 as ref from meas) group by device""", "offset_db spread_db"))
def phone_calibration(t: Tables):
    attempts = t.meas.select(
        F.col("who").alias("device"), F.col("noise_db").alias("measured_db"), F.lit(0.5).alias("current_offset_db"),
        (F.col("noise_db") + 1 + (F.col("obs_id") % 5) * 0.4).alias("reference_db"),
    )
    return energy.combine_calibrations(attempts)


@query("gps_fusion", oracle(
    """select who, sum(x / (accuracy * accuracy)) / sum(1e0 / (accuracy * accuracy)) as x, sum(y / (accuracy * accuracy)) / sum(1e0 / (accuracy * accuracy)) as y,
       cast(min(best) as int) as accuracy_m, count(*) as n_used from (select *, min(accuracy) over (partition by who) as best from meas where accuracy > 0) where accuracy <= 2 * best group by who""",
    "x y"))
def gps_fusion(t: Tables):
    return energy.fuse_fixes(t.meas, "who")


@query("feature_domain", oracle(
    "select collector, quantile_cont(noise_db, 0.05) as p05, quantile_cont(noise_db, 0.95) as p95 from meas group by 1", "p05 p95"))
def feature_domain(t: Tables):
    return describe.domain_overlap(t.meas, "collector", "noise_db")


@query("development_names", oracle(
    "select c_custkey, c_name from customer where regexp_matches(c_name, '1[05]|customer#0000000[24]', 'i')"))
def development_names(t: Tables):
    """Name filter by a case-insensitive pattern, as used on development names."""
    return t.raw("customer").where(F.col("c_name").rlike("(?iu)1[05]|customer#0000000[24]")).select("c_custkey", "c_name")


@query("unit_kinds", oracle(
    """select c_custkey, case when starts_with(c_name, 'Customer#0000001') then 'phuong' else 'xa' end as kind from customer"""))
def unit_kinds(t: Tables):
    return t.raw("customer").select("c_custkey", survey.unit_kind(F.col("c_name"), "Customer#0000001").alias("kind"))


@query("road_classes", oracle("select road_id, kind as road_class from roads"))
def road_classes(t: Tables):
    return t.roads.select("road_id", survey.road_class(F.array("highway", F.lit("secondary"))).alias("road_class"))


@query("centre_with_refusal", oracle(
    """select obs_id, site, d as distance_m, d > 4000 as outside from (select obs_id, s.site, d, row_number() over (partition by obs_id order by d, s.site) as rn from
        (select obs_id, s.site, 2 * 6371000e0 * asin(least(1, sqrt(pow(sin(radians(s.lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - longitude) / 2), 2)))) as d
         from located, (values ('site0', 21e0, 105.85e0 - 12000 / 104000e0), ('site1', 21e0, 105.85e0), ('site2', 21e0, 105.85e0 + 12000 / 104000e0)) s(site, lat, lon)) s) where rn = 1""",
    "distance_m"))
def centre_with_refusal(t: Tables):
    centres = [(name, 21.0, 105.85 + (i - 1) * 12000 / 104000.0) for i, (name, _, _) in enumerate(CENTRES)]
    best = cleaning.centre_or_outside(F.col("latitude"), F.col("longitude"), centres, 4000.0)
    return t.located.select("obs_id", best.alias("b")).select("obs_id", "b.site", "b.distance_m", "b.outside")


@query("utm_round_trip", oracle("select obs_id, x as x, y as y, true as in_city from obs", "x y"))
def utm_round_trip(t: Tables):
    """To degrees and back through the projection: positions must return."""
    lon, lat = geo.lonlat_from_utm(F.col("x"), F.col("y"), 48)
    degrees = t.obs.select("obs_id", lon.alias("lon"), lat.alias("lat"))
    x, y = geo.utm_from_lonlat(F.col("lon"), F.col("lat"), 48)
    inside = F.col("lon").between(105.7, 106.2) & F.col("lat").between(20.9, 21.1)
    return degrees.select("obs_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), inside.alias("in_city"))


@query("grouped_correlation", oracle(
    """select site, count(*) as n, corr(noise_db, temperature_2m) as r_temperature_2m, corr(noise_db, wind_speed_10m) as r_wind_speed_10m from wet group by rollup(site)""",
    "r_temperature_2m r_wind_speed_10m", wet=_WET))
def grouped_correlation(t: Tables):
    return describe.correlations(_with_weather(t), "noise_db", ["temperature_2m", "wind_speed_10m"], ["site"])
