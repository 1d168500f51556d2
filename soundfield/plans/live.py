"""Batch twins of the streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundfield.plans.registry import query
from soundfield.plans.tables import Tables, oracle
from soundfield.streaming import jobs


def _clean(t: Tables):
    return jobs.clean_batch(jobs.with_event_time(t.obs), offsets={"c0": 1.5})


_CLEAN = "select *, noise_db + case when collector = 'c0' then 1.5e0 else 0e0 end as level from obs where (accuracy is null or accuracy < 50) and noise_db between 20 and 120"


@query("hourly_windows", oracle(
    "select cast(epoch_us(date_trunc('hour', ts)) as bigint) as start_us, site, count(*) as n, 10 * log10(avg(pow(10e0, level / 10))) as laeq_db from c group by 1, 2", "laeq_db", c=_CLEAN))
def hourly_windows(t: Tables):
    return jobs.windowed_levels(_clean(t), delay=None).select(F.unix_micros("start").alias("start_us"), "site", "n", "laeq_db")


@query("sliding_windows", oracle(
    """select cast(epoch_us(date_trunc('hour', ts) - interval 1 hour * k) as bigint) as start_us, site, count(*) as n, 10 * log10(avg(pow(10e0, level / 10))) as laeq_db
       from c, (select unnest([0, 1]) as k) ks group by 1, 2""", "laeq_db", c=_CLEAN))
def sliding_windows(t: Tables):
    got = jobs.windowed_levels(_clean(t), width="2 hours", slide="1 hour", delay=None)
    return got.select(F.unix_micros("start").alias("start_us"), "site", "n", "laeq_db")


@query("collector_sessions", oracle(
    """select collector, cast(epoch_us(min(ts)) as bigint) as start_us, count(*) as n, 10 * log10(avg(pow(10e0, level / 10))) as laeq_db from
       (select *, sum(fresh) over (partition by collector order by ts, seq) as s from (select *, case when ts - lag(ts) over (partition by collector order by ts, seq) < interval 15 minutes then 0 else 1 end as fresh from c)) group by collector, s""",
    "laeq_db", c=_CLEAN))
def collector_sessions(t: Tables):
    got = jobs.sessions(_clean(t), gap="15 minutes", delay=None)
    return got.select("collector", F.unix_micros("start").alias("start_us"), "n", "laeq_db")


@query("live_exceedance", oracle(
    """select *, laeq_db > limit_db as over from (select cast(epoch_us(h) as bigint) as start_us, site, n, laeq_db, case when extract(hour from h) >= 21 or extract(hour from h) < 6 then 55e0 else 70e0 end as limit_db from
       (select date_trunc('hour', ts) as h, site, count(*) as n, 10 * log10(avg(pow(10e0, level / 10))) as laeq_db from c group by 1, 2))""", "laeq_db limit_db", c=_CLEAN))
def live_exceedance(t: Tables):
    got = jobs.live_exceedance(_clean(t), delay=None)
    return got.select(F.unix_micros("start").alias("start_us"), "site", "n", "laeq_db", "limit_db", "over")


@query("meter_levels")
def meter_levels(t: Tables):
    """SLOW-weighted level per device over event readings."""
    readings = t.obs.select(
        F.col("collector").alias("device"), F.col("ts_us").alias("t_us"), "seq", (F.col("noise_db") / 100.0).alias("pressure")
    )
    return jobs.meter_batch(readings, tau=60.0, slice_s=36000)
