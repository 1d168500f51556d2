"""Queries over tracked detections, videos and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions import timing
from soundfield.operators import describe, energy, traffic
from soundfield.operators.matching import nearest_in_time
from soundfield.operators.scenario import Scenario
from soundfield.operators.scans import flag_repeats, with_scalars
from soundfield.plans.registry import query
from soundfield.plans.tables import IMAGE, Tables, oracle

_W, _H = IMAGE

_VOTES = """select video_id, track_id, cls as track_cls, votes from (select *, row_number() over (partition by video_id, track_id order by votes desc, f, s, x, y, cls) as rn from
 (select video_id, track_id, cls, count(*) as votes, (array_agg(frame order by frame, sub, cx, cy))[1] as f, (array_agg(sub order by frame, sub, cx, cy))[1] as s,
   (array_agg(cx order by frame, sub, cx, cy))[1] as x, (array_agg(cy order by frame, sub, cx, cy))[1] as y from detections group by 1, 2, 3)) where rn = 1"""
_AXES = """select video_id, sum(sx) as span_x, sum(sy) as span_y, case when sum(sx) / 1000 > sum(sy) / 1000 then 'x' else 'y' end as axis from
 (select video_id, track_id, max(cx) - min(cx) as sx, max(cy) - min(cy) as sy from detections group by 1, 2) group by 1"""
_SIDES = """select * from (select d.*, case when v > 550 then 1 when v < 450 then -1 end as side from (select d.*, case when axis = 'x' then cx else cy end as v from detections d join axes using (video_id)) d) where side is not null"""
_CROSS = """select video_id, track_id, least(sum((side = 1)::int), 1) as forward, least(sum((side = -1)::int), 1) as backward, count(*) as raw_changes from
 (select *, lag(side) over (partition by video_id, track_id order by frame, sub, cx, cy) as prev from sides) where prev is not null and prev <> side group by 1, 2"""
_CTES = {"votes_t": _VOTES, "axes": _AXES, "sides": _SIDES, "crossed": _CROSS}


@query("track_classes", oracle("select * from votes_t", votes_t=_VOTES))
def track_classes(t: Tables):
    return traffic.track_classes(traffic.track_summary(t.detections))


@query("dominant_axis", oracle("select * from axes", "span_x span_y", axes=_AXES))
def dominant_axis(t: Tables):
    return traffic.dominant_axis(traffic.track_summary(t.detections), _W, _H)


@query("line_crossings", oracle(
    "select video_id, track_id, cast(forward as bigint) as forward, cast(backward as bigint) as backward, raw_changes, cast(forward + backward as bigint) as crossings from crossed", **_CTES))
def line_crossings(t: Tables):
    return traffic.crossings(t.detections, _W, _H)


_FLOW = """select c.video_id, v.track_cls as cls, cast(sum(forward + backward) as bigint) as crossings, w.duration_s, sum(forward + backward) / (w.duration_s / 60) as flow_per_min
 from crossed c join votes_t v on v.video_id = c.video_id and v.track_id = c.track_id join videos w on w.video_id = c.video_id group by 1, 2, w.duration_s"""


@query("flow_per_class", oracle(_FLOW, "duration_s flow_per_min", **_CTES))
def flow_per_class(t: Tables):
    return traffic.flow_per_class(t.detections, t.videos, _W, _H)


_DENSITY = """select v.video_id, coalesce(n_car, 0) / v.n_frames as car_mean, coalesce(n_moto, 0) / v.n_frames as moto_mean, coalesce(n_truck, 0) / v.n_frames as truck_mean,
 coalesce(n_all, 0) / v.n_frames as vehicles_mean from (select *, cast(n_frames as double) as nf from videos) v left join
 (select video_id, count(*) filter (cls = 'car') as n_car, count(*) filter (cls = 'moto') as n_moto, count(*) filter (cls = 'truck') as n_truck, count(*) as n_all from detections group by 1) d on d.video_id = v.video_id"""


@query("density_per_video", oracle(_DENSITY, "car_mean moto_mean truck_mean vehicles_mean"))
def density_per_video(t: Tables):
    got = traffic.density_per_video(traffic.track_summary(t.detections), t.videos)
    return got.select("video_id", "car_mean", "moto_mean", "truck_mean", "vehicles_mean")


_DWELL = "select video_id, count(*) as n_tracks, avg(len) / 10 as dwell_s from (select video_id, track_id, count(*) as len from detections group by 1, 2) group by 1"


@query("track_dwell", oracle(_DWELL, "dwell_s"))
def track_dwell(t: Tables):
    return traffic.dwell(traffic.track_summary(t.detections))


_COUNTS = """select v.video_id, v.start_s, round_even(d.car_mean, 2) as car_mean, round_even(d.moto_mean, 2) as moto_mean, round_even(d.truck_mean, 2) as truck_mean, round_even(d.vehicles_mean, 2) as vehicles_mean,
 round_even(coalesce(f.car, 0), 2) as car_flow, round_even(coalesce(f.moto, 0), 2) as moto_flow, round_even(coalesce(f.truck, 0), 2) as truck_flow,
 round_even(coalesce(f.car, 0) + coalesce(f.moto, 0) + coalesce(f.truck, 0), 2) as vehicles_flow, coalesce(w.n_tracks, 0) as n_tracks, round_even(coalesce(w.dwell_s, 0), 2) as dwell_s, coalesce(a.axis, 'y') as line_axis
 from videos v join density d on d.video_id = v.video_id left join (select video_id, max(flow_per_min) filter (cls = 'car') as car, max(flow_per_min) filter (cls = 'moto') as moto, max(flow_per_min) filter (cls = 'truck') as truck from flow group by 1) f on f.video_id = v.video_id
 left join dwelt w on w.video_id = v.video_id left join axes a on a.video_id = v.video_id"""
_CC = {**_CTES, "flow": _FLOW, "density": _DENSITY, "dwelt": _DWELL, "vc": _COUNTS}
_COUNT_COLUMNS = ("video_id", "start_s", "car_mean", "moto_mean", "truck_mean", "vehicles_mean", "car_flow", "moto_flow", "truck_flow",
                  "vehicles_flow", "n_tracks", "dwell_s", "line_axis")


def _counts(t: Tables):
    return traffic.video_counts(t.detections, t.videos, _W, _H)


@query("video_counts", oracle("select * from vc", "car_mean moto_mean truck_mean vehicles_mean car_flow moto_flow truck_flow vehicles_flow dwell_s", **_CC))
def video_counts(t: Tables):
    return _counts(t).select(*_COUNT_COLUMNS)


@query("littles_law", oracle(
    """select median(imp) as implied_s, median(dwell_s) as observed_s, median(imp / nullif(dwell_s, 0)) as ratio, median(imp / nullif(dwell_s, 0)) > 0.3 and median(imp / nullif(dwell_s, 0)) < 3 as consistent
       from (select *, vehicles_mean / (vehicles_flow / 60) as imp from vc where vehicles_flow > 0 and vehicles_mean > 0)""", "implied_s observed_s ratio", **_CC))
def littles_law(t: Tables):
    return traffic.littles_law(_counts(t))


@query("flow_kpis", oracle("select count(*) as n, avg(vehicles_flow) as mean_flow, max(vehicles_flow) as max_flow, median(vehicles_flow) as median_flow from vc", "mean_flow max_flow median_flow", **_CC))
def flow_kpis(t: Tables):
    return traffic.flow_kpis(_counts(t))


_MATCHED = """select v.*, m.site, m.noise_db as matched_db, cast(floor(v.start_s / 3600) as int) % 24 as hour from vc v left join
 (select * from (select v.video_id, m.site, m.noise_db, row_number() over (partition by v.video_id order by abs(m.ts_us - v.start_us), m.seq) as rn from videos v join meas m on m.ts_us between v.start_us - 300000000 and v.start_us + 300000000) where rn = 1) m
 on m.video_id = v.video_id"""
_CM = {**_CC, "vm": _MATCHED}


def _matched_counts(t: Tables):
    right = t.meas.select("ts_us", "seq", "noise_db", "site")
    counts = _counts(t).withColumn("start_us", F.col("start_s") * 1000000)
    got = nearest_in_time(counts, right, left_us="start_us", right_us="ts_us", tolerance_us=C.MATCH_MAX_S * 1_000_000)
    return got.withColumnRenamed("noise_db", "matched_db").withColumn("hour", (F.floor(F.col("start_s") / 3600) % 24).cast("int"))


@query("flow_dispersion", oracle(
    """select count(*) as groups, quantile_cont(cv, 0.25) as cv_q1, median(cv) as cv_median, quantile_cont(cv, 0.75) as cv_q3 from
       (select stddev_samp(vehicles_flow) / nullif(avg(vehicles_flow), 0) as cv from vm where site is not null group by site, hour having count(*) >= 3) where cv is not null""", "cv_q1 cv_median cv_q3", **_CM))
def flow_dispersion(t: Tables):
    rows = _matched_counts(t).where("site is not null")
    return traffic.flow_dispersion(rows)


@query("flow_correlations", oracle(
    """select site, count(*) as n, corr(matched_db, vehicles_mean) as r_vehicles_mean, corr(matched_db, vehicles_flow) as r_vehicles_flow, corr(matched_db, moto_flow) as r_moto_flow
       from vm where site is not null group by rollup(site)""", "r_vehicles_mean r_vehicles_flow r_moto_flow", **_CM))
def flow_correlations(t: Tables):
    rows = _matched_counts(t).where("site is not null")
    return describe.correlations(rows, "matched_db", ["vehicles_mean", "vehicles_flow", "moto_flow"], ["site"])


_OBSERVED = """select site, hour, count(*) as n_videos, avg(matched_db) as mean_db, avg(moto_mean) as moto, avg(car_mean) as car, avg(truck_mean) as truck, avg(moto_flow) as moto_fl, avg(car_flow) as car_fl,
 avg(truck_flow) as truck_fl, avg(moto_mean) + avg(car_mean) + avg(truck_mean) as total, avg(moto_flow) + avg(car_flow) + avg(truck_flow) as total_fl from vm where site is not null group by 1, 2"""


@query("fleet_observed", oracle("select * from fo", "mean_db moto car truck moto_fl car_fl truck_fl total total_fl", **_CM, fo=_OBSERVED))
def fleet_observed(t: Tables):
    return traffic.fleet_observed(_matched_counts(t)).drop("bus", "bus_fl")


_FILL = """select site_name, hour, n_videos, measured, coalesce(case when h1 > h0 then v0 + (v1 - v0) * ((hour - h0) / cast(h1 - h0 as double)) end, v0, v1) as total from
 (select s.site as site_name, h.hour, coalesce(o.n_videos, 0) as n_videos, case when o.n_videos is null then 0 else 1 end as measured,
   (select max(hour) from gappy g where g.site = s.site and g.hour <= h.hour) as h0, (select min(hour) from gappy g where g.site = s.site and g.hour >= h.hour) as h1
  from (select distinct site from gappy) s cross join (select cast(unnest(range(5, 22)) as int) as hour) h left join gappy o on o.site = s.site and o.hour = h.hour) f
 left join (select site as s0, hour as k0, total as v0 from gappy) a on a.s0 = site_name and a.k0 = h0 left join (select site as s1, hour as k1, total as v1 from gappy) b on b.s1 = site_name and b.k1 = h1"""
# only hours with many videos count as measured, so that there are gaps to fill
_GAPPY = "select * from fo where hour between 5 and 21 and n_videos >= (select avg(n_videos) from fo)"


def _gappy(t: Tables):
    seen = traffic.fleet_observed(_matched_counts(t))
    kept = with_scalars(seen, seen.agg(F.avg("n_videos").alias("__mean")))
    return kept.where(F.col("n_videos") >= F.col("__mean")).drop("__mean")


@query("hours_filled", oracle("select * from ff", "total", **_CM, fo=_OBSERVED, gappy=_GAPPY, ff=_FILL))
def hours_filled(t: Tables):
    """Gap interpolation: linear between measured hours, nearest value at the ends."""
    filled = traffic.fill_hours(_gappy(t), ["total"])
    return filled.select(F.col("site").alias("site_name"), "hour", "n_videos", "measured", "total")


_FRAME = """select s.site, h.hour, (select max(hour) from seen g where g.site = s.site and g.hour <= h.hour) as h0, (select min(hour) from seen g where g.site = s.site and g.hour >= h.hour) as h1
 from (select distinct site from fo) s cross join (select cast(unnest(range(5, 22)) as int) as hour) h"""


def _line(column: str) -> str:
    return f"coalesce(case when h1 > h0 then a.{column} + (b.{column} - a.{column}) * ((f.hour - h0) / cast(h1 - h0 as double)) end, a.{column}, b.{column})"


_FLEET = f"""select site_name, hour, measured, n_videos, round_even(total, 3) as total, round_even(total_fl, 3) as total_flow_per_min, 0e0 as bus_share, 0e0 as bus_flow_per_min,
 {", ".join(f"case when total > 0 then round_even({c} / total, 4) else 0 end as {c}_share, round_even({c}_fl, 3) as {c}_flow_per_min" for c in ("moto", "car", "truck"))}
 from (select f.site as site_name, f.hour, case when o.n_videos is null then 0 else 1 end as measured, coalesce(o.n_videos, 0) as n_videos,
 {", ".join(f"{_line(c)} as {c}" for c in ("moto", "car", "truck", "total", "moto_fl", "car_fl", "truck_fl", "total_fl"))}
 from frame f left join seen o on o.site = f.site and o.hour = f.hour left join seen a on a.site = f.site and a.hour = h0 left join seen b on b.site = f.site and b.hour = h1)"""


@query("fleet_by_hour", oracle(
    "select * from fleet", "total moto_share car_share truck_share bus_share total_flow_per_min moto_flow_per_min car_flow_per_min truck_flow_per_min bus_flow_per_min",
    **_CM, fo=_OBSERVED, seen="select * from fo where hour between 5 and 21", frame=_FRAME, fleet=_FLEET))
def fleet_by_hour(t: Tables):
    return traffic.fleet_by_hour(_matched_counts(t))


_SEEN = "select * from fo where hour between 5 and 21"


@query("fleet_shares", oracle(
    "select site_name, hour, measured, moto_share, car_share, truck_share, bus_share from fleet where total > 0",
    "moto_share car_share truck_share bus_share", **_CM, fo=_OBSERVED, seen=_SEEN, frame=_FRAME, fleet=_FLEET))
def fleet_shares(t: Tables):
    got = traffic.fleet_by_hour(_matched_counts(t)).where("total > 0")
    return got.select("site_name", "hour", "measured", "moto_share", "car_share", "truck_share", "bus_share")


@query("hour_by_site", oracle(
    """select hour, max(total) filter (site_name = 'site0') as site0, max(total) filter (site_name = 'site1') as site1, max(total) filter (site_name = 'site2') as site2 from ff group by 1""",
    "site0 site1 site2", **_CM, fo=_OBSERVED, gappy=_GAPPY, ff=_FILL))
def hour_by_site(t: Tables):
    filled = traffic.fill_hours(_gappy(t), ["total"]).withColumnRenamed("site", "site_name")
    return traffic.hour_by_site(filled, ["site0", "site1", "site2"])


@query("flow_state", oracle(
    """select scenario, site_name, hour, fl as flow, ms as moto_share, case when fl > 0 then least(1 - ms, car * k / fl) else 0.35 end as car_share,
        case when measured = 1 then 'measured' else 'interpolated' end as traffic_source from
       (select *, total * k as fl, case when total * k > 0 then least(1, moto * k / (total * k)) else 0.5 end as ms from
         (select site_name, hour, measured, coalesce(total_flow_per_min, 0) as total, coalesce(moto_flow_per_min, 0) as moto, coalesce(car_flow_per_min, 0) as car from fleet),
         (values ('base', 1e0), ('double', 2e0), ('pedestrian', 0.2e0)) s(scenario, k))""", "flow moto_share car_share",
    **_CM, fo=_OBSERVED, seen=_SEEN, frame=_FRAME, fleet=_FLEET))
def flow_state(t: Tables):
    fleet = traffic.fleet_by_hour(_matched_counts(t))
    return traffic.flow_state(fleet, [Scenario("base"), Scenario("double", 2.0), Scenario("pedestrian", 1.0, "pedestrian")])


_INDEX = """select video_id, case when video_id % 7 = 0 then cast(null as double) else 20 + (video_id % 1000) / 1e3 end as latitude, case when video_id % 7 = 0 then cast(null as double) else 105 + (video_id % 900) / 1e3 end as longitude, duration_s from videos"""


def _index(t: Tables):
    lat, lon = F.format_string("%.3f", 20 + (F.col("video_id") % 1000) / 1e3), F.format_string("%.3f", 105 + (F.col("video_id") % 900) / 1e3)
    text = F.when(F.col("video_id") % 7 != 0, F.concat(F.lit("+"), lat, F.lit("+"), lon, F.lit("+010.0/")))
    stamp = F.concat(F.lit("/media/VID_202401"), F.format_string("%02d", 1 + F.col("video_id") % 30), F.lit("_"), F.format_string("%02d", F.col("video_id") % 24), F.lit("1530.mp4"))
    return t.videos.select("video_id", "duration_s", text.alias("iso6709"), stamp.alias("path"))


@query("video_positions", oracle("select video_id, latitude, longitude from ix", "latitude longitude", ix=_INDEX))
def video_positions(t: Tables):
    loc = F.col("iso6709")
    return _index(t).select("video_id", timing.iso6709_latitude(loc).alias("latitude"), timing.iso6709_longitude(loc).alias("longitude"))


@query("video_index_summary", oracle(
    "select count(*) as n, count(latitude) as n_located, sum(duration_s) / 60 as minutes from ix", "minutes", ix=_INDEX))
def video_index_summary(t: Tables):
    return traffic.video_index_summary(_index(t).withColumn("latitude", timing.iso6709_latitude(F.col("iso6709"))))


@query("video_starts", oracle(
    """select video_id, cast(epoch_us(make_timestamp(2024, 1, 1 + video_id % 30, video_id % 24, 15, 30)) as bigint) as start_us from videos"""))
def video_starts(t: Tables):
    start = timing.video_start(timing.base_name(F.col("path")))
    return _index(t).select("video_id", F.unix_micros(start.cast("timestamp")).alias("start_us"))


@query("geopoints", oracle("select obs_id, x, y, cast(accuracy as double) as accuracy from obs where accuracy is not null", "x y accuracy"))
def geopoints(t: Tables):
    text = F.concat_ws(" ", F.format_string("%.1f", "x"), F.format_string("%.1f", "y"), F.lit("7.5"), F.col("accuracy").cast("string"))
    rows = t.obs.where("accuracy is not null").select("obs_id", text.alias("p"))
    part = lambda i: timing.geopoint_part(F.col("p"), i)
    return rows.select("obs_id", part(1).alias("x"), part(2).alias("y"), part(4).alias("accuracy"))


# --------------------------------------------------------------------------------- clips


@query("clip_spectra")
def clip_spectra(t: Tables):
    """Band energies of short windows; embedding vectors stand in for samples."""
    clips = t.raw("embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("pcm"))
    return energy.clip_spectrum(clips, frame=32, hop=16)


_CLIPS = """select doc_id as clip_id, md5(text) as md5, (n_chars % 997) / 9e6 as median_rms, (doc_id * 37 % 101) / 100e0 as band_low, (n_chars % 89) / 300e0 as band_mid, (n_chars % 7) * (doc_id % 5) / 40e0 as band_high from documents"""


@query("clip_flags", oracle(
    """select clip_id, median_rms < 1e-4 as flag_silence, abs(band_low - l) > 3 * ld as flag_band_low, abs(band_mid - m) > 3 * md as flag_band_mid, abs(band_high - h) > 3 * hd as flag_band_high, rn > 1 as flag_duplicate,
       median_rms < 1e-4 or abs(band_low - l) > 3 * ld or abs(band_mid - m) > 3 * md or abs(band_high - h) > 3 * hd or rn > 1 as any_flag
       from (select *, row_number() over (partition by md5 order by clip_id) as rn from clips), (select median(band_low) as l, median(band_mid) as m, median(band_high) as h from clips) c,
        (select median(abs(band_low - (select median(band_low) from clips))) as ld, median(abs(band_mid - (select median(band_mid) from clips))) as md, median(abs(band_high - (select median(band_high) from clips))) as hd from clips) s""", clips=_CLIPS))
def clip_flags(t: Tables):
    d = F.col("doc_id")
    clips = t.raw("documents").select(
        d.alias("clip_id"), F.md5("text").alias("md5"), (F.col("n_chars") % 997 / 9e6).alias("median_rms"),
        (d * 37 % 101 / 100.0).alias("band_low"), (F.col("n_chars") % 89 / 300.0).alias("band_mid"),
        ((F.col("n_chars") % 7) * (d % 5) / 40.0).alias("band_high"),
    )
    return energy.clip_flags(clips).drop("md5", "median_rms", "band_low", "band_mid", "band_high")


@query("repeated_texts", oracle("select doc_id, row_number() over (partition by md5(text) order by doc_id) > 1 as repeat from documents"))
def repeated_texts(t: Tables):
    hashed = t.raw("documents").select("doc_id", F.md5("text").alias("h"))
    return flag_repeats(hashed, ["h"], F.col("doc_id")).drop("h")
