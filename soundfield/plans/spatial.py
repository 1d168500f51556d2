"""Queries that join by place or by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions import geo
from soundfield.models import features
from soundfield.operators import areas, describe, evaluation, grid, matching, polylines, scenario, shapes
from soundfield.operators.lattice import disc_sums, nearest_points
from soundfield.plans.registry import query
from soundfield.plans.tables import Tables, oracle

_AREA = "(pi() * 90000)"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_FOOT = "least(greatest(coalesce(((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 0), 1)"


def _to_segment(points: str) -> str:
    """Distances of every distinct position to every road, brute force."""
    return f"""select px, py, road_id, kind, length_m, sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)) as d from
     (select p.x as px, p.y as py, road_id, kind, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length_m, x1 + {_FOOT} * (x2 - x1) as fx, y1 + {_FOOT} * (y2 - y1) as fy
      from (select distinct x, y from {points}) p, roads)"""


@query("video_match", oracle(
    """select v.video_id, m.obs_id, m.noise_db as matched_db, cast(floor(m.gap_us / 1000000) as bigint) as match_gap_s from videos v left join
       (select video_id, obs_id, noise_db, gap_us from (select video_id, obs_id, noise_db, abs(ts_us - start_us) as gap_us,
          row_number() over (partition by video_id order by abs(ts_us - start_us), seq) as rn from videos join meas on ts_us between start_us - 300000000 and start_us + 300000000) where rn = 1) m
       on m.video_id = v.video_id""", "matched_db"))
def video_match(t: Tables):
    """As-of join: each video with the measurement nearest in time, within 300 s."""
    return _matched(t).select(
        "video_id", "obs_id", F.col("noise_db").alias("matched_db"), F.floor(F.col("gap_us") / 1000000).alias("match_gap_s")
    )


def _matched(t: Tables):
    right = t.meas.select("ts_us", "seq", "obs_id", "noise_db", "ts")
    return matching.nearest_in_time(
        t.videos, right, left_us="start_us", right_us="ts_us", tolerance_us=C.MATCH_MAX_S * 1_000_000
    )


_MATCH = """select * from (select v.*, m.obs_id, m.ts as matched_ts, m.noise_db as matched_db, row_number() over (partition by v.video_id order by abs(m.ts_us - v.start_us), m.seq) as rn
 from videos v join meas m on m.ts_us between v.start_us - 300000000 and v.start_us + 300000000) where rn = 1"""


@query("counts_with_site", oracle(
    """select v.video_id, s.site from videos v left join matched k on k.video_id = v.video_id left join meas s on s.ts = k.matched_ts""", matched=_MATCH))
def counts_with_site(t: Tables):
    counts = _matched(t).withColumnRenamed("ts", "matched_ts")
    return matching.with_site_of_match(counts, t.meas).select("video_id", "site")


@query("covered_measurements", oracle(
    "select obs_id, noise_db from meas where obs_id in (select obs_id from matched)", "noise_db", matched=_MATCH))
def covered_measurements(t: Tables):
    return matching.covered(t.meas.select("obs_id", "noise_db"), _matched(t), "obs_id")


@query("pending_videos", oracle(
    """select video, video_id from (select 'VID_' || cast(video_id // 2 as string) || '.mp4' as video, min(video_id) as video_id from videos group by 1)
       where video not in (select 'VID_' || cast(video_id as string) || '.mp4' from detections)"""))
def pending_videos(t: Tables):
    """Files not counted yet; a name found in two folders is one video."""
    names = t.videos.select(
        "video_id", F.concat(F.lit("VID_"), F.expr("video_id div 2").cast("string"), F.lit(".mp4")).alias("video")
    )
    done = t.detections.select(F.concat(F.lit("VID_"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("video"))
    return matching.pending(matching.first_per_key(names, "video", "video_id"), done)


@query("sensor_positions", oracle(
    """select c.who, c.hour, c.n, p.x, p.y from (select who, hour, count(*) as n from meas group by 1, 2) c
       join (select who, x, y from (select *, row_number() over (partition by who order by seq) as rn from meas) where rn = 1) p on p.who = c.who""", "x y"))
def sensor_positions(t: Tables):
    """Inner join of aggregated cells to a de-duplicated position table."""
    cells = t.meas.groupBy("who", "hour").agg(F.count(F.lit(1)).alias("n"))
    places = matching.first_per_key(t.meas.select("who", "seq", "x", "y"), "who", "seq").drop("seq")
    return cells.join(places, "who")


@query("repeated_times", oracle("select who, hour, count(*) as n from meas group by 1, 2 having count(*) > 1"))
def repeated_times(t: Tables):
    return matching.repeated_keys(t.meas, "who", "hour")


@query("disc_morphology", oracle(
    f"""select p.x, p.y, least(coalesce(a.built, 0) / {_AREA}, 1) as built_area_ratio, coalesce(a.n, 0) / ({_AREA} / 1e6) as building_density_km2, coalesce(c.n, 0) as intersection_count
        from (select distinct x, y from meas) p
        left join (select a.x, a.y, sum(side_m * side_m) as built, count(*) as n from (select distinct x, y from meas) a join (select *, cx as x, cy as y from buildings) b on {_DIST} < 300 group by 1, 2) a on a.x = p.x and a.y = p.y
        left join (select a.x, a.y, count(*) as n from (select distinct x, y from meas) a join nodes b on {_DIST} < 300 group by 1, 2) c on c.x = p.x and c.y = p.y""",
    "x y built_area_ratio building_density_km2"))
def disc_morphology(t: Tables):
    return features.disc_morphology(t.meas, t.building_points, t.nodes)


@query("neighbour_counts", oracle(
    f"select a.x, a.y, count(*) as n, avg(b.noise_db) as mean_db from (select distinct x, y from obs) a join obs b on {_DIST} <= 300 group by 1, 2", "x y mean_db"))
def neighbour_counts(t: Tables):
    got = disc_sums(t.obs, t.obs, 300.0, {"n": F.lit(1).cast("bigint"), "s": F.col("noise_db")}, strict=False)
    return got.select("x", "y", "n", (F.col("s") / F.col("n")).alias("mean_db"))


@query("road_density", oracle(
    f"""select p.x, p.y, coalesce(len, 0) / 1000 / ({_AREA} / 1e6) as road_density_km_km2 from (select distinct x, y from meas) p
        left join (select px, py, sum(length_m) as len from seg where d <= 300 group by 1, 2) s on s.px = p.x and s.py = p.y""",
    "x y road_density_km_km2", seg=_to_segment("meas")))
def road_density(t: Tables):
    return features.road_density(t.meas, t.roads)


@query("road_distances", oracle(
    """select px as x, py as y, min(d) as dist_road_m, min(d) filter (kind = 'major') as dist_highway_m, min(d) filter (kind = 'minor') as dist_residential_m from seg group by 1, 2""",
    "x y dist_road_m dist_highway_m dist_residential_m", seg=_to_segment("meas")))
def road_distances(t: Tables):
    return features.road_distances(t.meas, t.roads)


@query("eight_nearest", oracle(
    f"""select x, y, cast(rn as int) as rank, d, obs_id from (select a.x, a.y, b.obs_id, {_DIST} as d, row_number() over (partition by a.x, a.y order by {_DIST}, b.seq) as rn
        from (select distinct x, y from meas) a, meas b) where rn <= 8""", "x y d"))
def eight_nearest(t: Tables):
    return nearest_points(t.meas, t.meas.select("x", "y", "seq", "obs_id"), 8).drop("seq")


@query("points_in_wards", oracle(
    """select obs_id, ward_id, ward from obs left join wards on x >= x_lo and x < x_lo + w and y >= y_lo and y < y_lo + h"""))
def points_in_wards(t: Tables):
    return shapes.points_in_polygons(t.obs.select("obs_id", "x", "y"), t.ward_rings).select("obs_id", "ward_id", "ward")


_BOX = "select site, min(x) - 400 as x_lo, min(y) - 400 as y_lo, max(x) + 400 as x_hi, max(y) + 400 as y_hi from meas group by site"


@query("site_envelopes", oracle("select * from box", "x_lo y_lo x_hi y_hi", box=_BOX))
def site_envelopes(t: Tables):
    return shapes.envelope(t.meas, C.ENVELOPE_MARGIN_M)


def _small_zones(t: Tables):
    """Boxes well inside the sites, so that clipping has something to cut."""
    box = shapes.envelope(t.meas, C.ENVELOPE_MARGIN_M)
    return box.select(
        "site", (F.col("x_lo") + 2000).alias("x_lo"), (F.col("y_lo") + 1500).alias("y_lo"),
        (F.col("x_hi") - 2500).alias("x_hi"), (F.col("y_hi") - 1000).alias("y_hi"),
    )


_ZONE = "select site, x_lo + 2000 as x_lo, y_lo + 1500 as y_lo, x_hi - 2500 as x_hi, y_hi - 1000 as y_hi from box"


@query("points_in_zones", oracle(
    "select obs_id, z.site as zone from obs o join zone z on o.x between x_lo and x_hi and o.y between y_lo and y_hi", box=_BOX, zone=_ZONE))
def points_in_zones(t: Tables):
    zones = _small_zones(t).withColumnRenamed("site", "zone")
    return shapes.clip_points(t.obs.select("obs_id", "x", "y"), zones).select("obs_id", "zone")


@query("roads_clipped", oracle(
    """select road_id, zone, round((t1 - t0) * sqrt(dx * dx + dy * dy), 3) as length_m from (
       select road_id, z.site as zone, x2 - x1 as dx, y2 - y1 as dy,
         greatest(0, case when x2 > x1 then (x_lo - x1) / (x2 - x1) when x2 < x1 then (x_hi - x1) / (x2 - x1) else 0 end, case when y2 > y1 then (y_lo - y1) / (y2 - y1) when y2 < y1 then (y_hi - y1) / (y2 - y1) else 0 end) as t0,
         least(1, case when x2 > x1 then (x_hi - x1) / (x2 - x1) when x2 < x1 then (x_lo - x1) / (x2 - x1) else 1 end, case when y2 > y1 then (y_hi - y1) / (y2 - y1) when y2 < y1 then (y_lo - y1) / (y2 - y1) else 1 end) as t1
       from roads r, zone z where (x1 <> x2 or x1 between x_lo and x_hi) and (y1 <> y2 or y1 between y_lo and y_hi)) where t0 <= t1""",
    "length_m", box=_BOX, zone=_ZONE))
def roads_clipped(t: Tables):
    zones = _small_zones(t).withColumnRenamed("site", "zone")
    parts = shapes.clip_segments(t.roads.drop("site"), zones)
    length = geo.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return parts.select("road_id", "zone", F.round(length, 3).alias("length_m"))


@query("buildings_clipped", oracle(
    """select * from (select bld_id, zone, round(w * h, 3) as area_m2 from (select bld_id, z.site as zone, least(cx + side_m / 2, x_hi) - greatest(cx - side_m / 2, x_lo) as w,
       least(cy + side_m / 2, y_hi) - greatest(cy - side_m / 2, y_lo) as h from buildings b, zone z) where w > 0 and h > 0) where area_m2 > 0""", "area_m2", box=_BOX, zone=_ZONE))
def buildings_clipped(t: Tables):
    zones = _small_zones(t).withColumnRenamed("site", "zone")
    parts = shapes.clip_rings(t.building_rings.select("bld_id", "ring"), zones)
    return parts.select("bld_id", "zone", F.round(geo.ring_area(F.col("ring")), 3).alias("area_m2")).where("area_m2 > 0")


@query("building_shapes", oracle(
    "select bld_id, round(side_m * side_m, 3) as area_m2, cx, cy, round(3 * side_m, 3) as open_length_m from buildings", "area_m2 cx cy open_length_m"))
def building_shapes(t: Tables):
    ring = F.col("ring")
    cx, cy = geo.ring_centroid(ring)
    return t.building_rings.select(
        "bld_id", F.round(geo.ring_area(ring), 3).alias("area_m2"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"),
        F.round(geo.polyline_length(ring), 3).alias("open_length_m"),
    )


@query("hull_areas")
def hull_areas(t: Tables):
    return shapes.hull_areas(t.meas)


@query("corridor_roads", oracle(
    """select road_id, r.site from roads r where exists (select 1 from seg s join (select distinct x, y, site from meas) m on m.x = s.px and m.y = s.py where s.road_id = r.road_id and m.site = r.site and s.d <= 150)
       or not exists (select 1 from seg s join roads r2 on r2.road_id = s.road_id join (select distinct x, y, site from meas) m on m.x = s.px and m.y = s.py where r2.site = r.site and m.site = r.site and s.d <= 150)""",
    seg=_to_segment("meas")))
def corridor_roads(t: Tables):
    return shapes.corridor(t.roads, t.meas, C.CORRIDOR_M).select("road_id", "site")


@query("grid_validation", oracle(
    """select count(*) as n, avg(e) as bias, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, corr(noise_db, sim) as r, 1 - sum(e * e) / (var_pop(noise_db) * count(*)) as r2,
       100e0 * avg(case when abs(e) <= 3 then 1e0 else 0e0 end) as within3, 100e0 * avg(case when abs(e) <= 5 then 1e0 else 0e0 end) as within5, median(d) as median_cell_dist_m
       from (select m.noise_db, g.level_db as sim, g.level_db - m.noise_db as e, d from near m join grid g on g.site = m.cell_site and g.ix = m.cix and g.iy = m.ciy and g.hour = m.hour)""",
    "bias mae rmse r r2 within3 within5 median_cell_dist_m", near="select * from (select a.*, b.site as cell_site, b.ix as cix, b.iy as ciy, " + _DIST + " as d, row_number() over (partition by a.obs_id order by " + _DIST +
    ", b.site, b.iy, b.ix) as rn from (select * from meas where hour between 5 and 21) a join cells b on b.x between a.x - 40 and a.x + 40 and b.y between a.y - 40 and a.y + 40) where rn = 1"))
def grid_validation(t: Tables):
    joined = grid.validate_against_grid(t.meas.select("obs_id", "x", "y", "hour", "noise_db"), t.layout, t.grid)
    return evaluation.validation_stats(joined)


def _validation(t: Tables):
    return grid.validate_against_grid(t.meas.select("obs_id", "x", "y", "hour", "noise_db", "site"), t.layout, t.grid)


_NEAR_CELL = "select * from (select a.*, b.site as cell_site, b.ix as cix, b.iy as ciy, " + _DIST + " as d, row_number() over (partition by a.obs_id order by " + _DIST + ", b.site, b.iy, b.ix) as rn from (select * from meas where hour between 5 and 21) a join cells b on b.x between a.x - 40 and a.x + 40 and b.y between a.y - 40 and a.y + 40) where rn = 1"
_ERRORS = "select m.site, m.hour, m.noise_db, g.level_db as sim, g.level_db - m.noise_db as error, d from near m join grid g on g.site = m.cell_site and g.ix = m.cix and g.iy = m.ciy and g.hour = m.hour"


@query("grid_errors_by_site", oracle(
    """select site, count(*) as n, avg(error) as bias, avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse, corr(noise_db, sim) as r, 1 - sum(error * error) / (var_pop(noise_db) * count(*)) as r2,
       100e0 * avg(case when abs(error) <= 3 then 1e0 else 0e0 end) as within3, 100e0 * avg(case when abs(error) <= 5 then 1e0 else 0e0 end) as within5, median(d) as median_cell_dist_m from er group by site""",
    "bias mae rmse r r2 within3 within5 median_cell_dist_m", near=_NEAR_CELL, er=_ERRORS))
def grid_errors_by_site(t: Tables):
    return evaluation.validation_stats(_validation(t), ["site"])


@query("error_by_hour_band", oracle(
    """select case when hour <= 8 then '5-8h' when hour <= 12 then '9-12h' when hour <= 16 then '13-16h' else '17-21h' end as hour_band, count(*) as n, min(error) as min, quantile_cont(error, 0.25) as q1, median(error) as median,
       quantile_cont(error, 0.75) as q3, max(error) as max from er group by 1""", "min q1 median q3 max", near=_NEAR_CELL, er=_ERRORS))
def error_by_hour_band(t: Tables):
    return describe.error_by_hour_band(_validation(t))


@query("error_histogram", oracle(
    """select bin, n, -20 + bin * 2e0 as bin_low, n / (sum(n) over () * 2e0) as density from (select cast(least(floor((error + 20) / 2e0), 19) as int) as bin, count(*) as n from er where error between -20 and 20 group by 1)""",
    "bin_low density", near=_NEAR_CELL, er=_ERRORS))
def error_histogram(t: Tables):
    return describe.histogram(_validation(t), F.col("error"), -20.0, 20.0, 2.0)


@query("frame_area", oracle(
    "select cast(floor((cx - 580000) / 12000) as bigint) as site_no, count(*) as n, sum(side_m * side_m) / 1e6 as area_km2 from buildings group by 1", "area_km2"))
def frame_area(t: Tables):
    """Summed polygon area by site."""
    site = F.floor((F.col("cx") - 580000) / 12000)
    return t.building_rings.groupBy(site.alias("site_no")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(geo.ring_area(F.col("ring"))) / 1e6).alias("area_km2")
    )


@query("cell_lookup", oracle(
    """select o.obs_id, n.cell_site, n.ix, n.iy, n.d as cell_dist_m from obs o left join (select * from (select a.obs_id, b.site as cell_site, b.ix, b.iy, """ + _DIST + """ as d,
       row_number() over (partition by a.obs_id order by """ + _DIST + """, b.site, b.iy, b.ix) as rn from obs a join cells b on b.x between a.x - 80 and a.x + 80 and b.y between a.y - 80 and a.y + 80)
       where rn = 1 and d <= 80) n on n.obs_id = o.obs_id""", "cell_dist_m"))
def cell_lookup(t: Tables):
    """Nearest grid cell, refused beyond 80 m."""
    got = grid.nearest_cell(t.obs.select("obs_id", "x", "y"), t.layout, reach=80.0)
    return got.select("obs_id", "cell_site", "ix", "iy", "cell_dist_m")


@query("construction_energies", oracle(
    f"""select a.x, a.y, 10 * log10(sum(pow(10e0, (64.7e0 - 20 * log10(greatest({_DIST}, 25) / 56e0)) / 10))) as level_db, count(*) as n_sources
        from (select distinct x, y from cells) a join sources b on {_DIST} <= 250 group by 1, 2""", "x y level_db"))
def construction_energies(t: Tables):
    got = scenario.construction_energies(grid.grid_cells(t.layout), t.sources)
    return got.select("x", "y", (10 * F.log10("construction_energy")).alias("level_db"), "n_sources")


@query("near_source_mean", oracle(
    f"""select site, hour, count(*) as cells, avg(level_db) as mean_db from grid g join (select distinct a.x, a.y from (select distinct x, y from cells) a join sources b on {_DIST} < 200) n
        on n.x = g.x and n.y = g.y group by 1, 2""", "mean_db"))
def near_source_mean(t: Tables):
    return scenario.near_source_mean(t.grid, t.sources, ["site", "hour"], "level_db")


@query("noise_ceiling", oracle(
    """select band as band_m, count(*) as pairs, avg(diff) as mean_abs_diff, avg(diff) * sqrt(pi()) / 2 as sigma,
        1 - pow(avg(diff) * sqrt(pi()) / 2, 2) / (select var_samp(noise_db) from meas) as ceiling_r2
       from (select abs(a.noise_db - b.noise_db) as diff, """ + _DIST + """ as d from meas a join meas b on a.hour = b.hour and a.obs_id < b.obs_id) p, (select unnest([20e0, 40e0, 60e0]) as band) k
       where d < band group by band""", "mean_abs_diff sigma ceiling_r2"))
def noise_ceiling(t: Tables):
    return evaluation.noise_ceiling(t.meas)


@query("local_plane", oracle(
    """select obs_id, 6371000e0 * radians(longitude) * cos(radians(21e0)) as px, 6371000e0 * radians(latitude) as py from located""", "px py"))
def local_plane(t: Tables):
    x, y = geo.local_plane(F.col("latitude"), F.col("longitude"), F.lit(21.0))
    return t.located.select("obs_id", x.alias("px"), y.alias("py"))


@query("site_grid", oracle("select site, ix, iy, x, y from cells", "x y"))
def site_grid(t: Tables):
    return grid.grid_cells(t.layout)


@query("grid_guard", oracle(
    """select count(*) as violations from grid g left join box b on b.site = g.site
       where b.site is null or x < x_lo or x > x_hi or y < y_lo or y > y_hi or not (level_db > 30 and level_db < 100)""", box=_BOX))
def grid_guard(t: Tables):
    """No cell outside its site's envelope, none of an unmeasured site, no implausible level."""
    return grid.extent_violations(t.grid, t.meas).agg(F.count(F.lit(1)).alias("violations"))


@query("wide_noise_map", oracle(
    "select site, ix, iy, " + ", ".join(f"max(level_db) filter (hour = {h}) as h{h}" for h in range(5, 22)) + " from grid group by 1, 2, 3",
    " ".join(f"h{h}" for h in range(5, 22))))
def wide_noise_map(t: Tables):
    return grid.wide_map(t.grid)


@query("kinds_united", oracle(
    """select kind, count(*) as n, avg(x) as mean_x from (select 'building' as kind, cx as x from buildings union all select 'node', x from nodes union all select 'source', x from sources) group by 1""", "mean_x"))
def kinds_united(t: Tables):
    parts = [t.buildings.select(F.lit("building").alias("kind"), F.col("cx").alias("x")), t.nodes.select(F.lit("node").alias("kind"), "x"),
             t.sources.select(F.lit("source").alias("kind"), "x")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))


_IN_WARD = """(x >= x_lo and x < x_lo + w and y >= y_lo and y < y_lo + h and abs(x - x_lo - w / 2 - 0.25e0) / (w / 4 + 0.1e0) + abs(y - y_lo - h / 2 - 0.25e0) / (h / 4 + 0.1e0) >= 1
  or abs(x - x_lo - 1.5e0 * w - 0.25e0) / (w / 8 + 0.1e0) + abs(y - y_lo - h / 2 - 0.25e0) / (h / 8 + 0.1e0) < 1)"""


@query("points_in_ward_areas", oracle(f"select obs_id, ward_id, ward from obs left join wards on {_IN_WARD}"))
def points_in_ward_areas(t: Tables):
    """Wards of two parts with holes."""
    return areas.points_in_areas(t.obs.select("obs_id", "x", "y"), t.ward_areas, "ward_id").select("obs_id", "ward_id", "ward")


_FRAME = f"select ward from wards join sources on {_IN_WARD} where src_id % 9 = 0"


def _frame(t: Tables):
    return areas.frame_membership(t.ward_areas, t.sources.where("src_id % 9 = 0"), "ward_id", "ward").select("ward_id", "ward", "kind", "in_frame")


@query("frame_wards", oracle("select ward_id, ward, kind, kind = 'phuong' or ward in (select ward from built) as in_frame from wards", built=_FRAME))
def frame_wards(t: Tables):
    """Urban wards, and wards that hold a development, are in the sampling frame."""
    return _frame(t)


@query("frame_measurements", oracle(
    f"""select in_frame, count(*) as n, count(distinct ward_id) as wards, avg(noise_db) as mean_db from obs join
        (select *, kind = 'phuong' or ward in (select ward from built) as in_frame from wards) on {_IN_WARD} where noise_db is not null group by 1""", "mean_db", built=_FRAME))
def frame_measurements(t: Tables):
    """Measurements inside the sampling frame and in its complement."""
    placed = areas.points_in_areas(t.obs.where("noise_db is not null").select("noise_db", "x", "y"), t.ward_areas, "ward_id").where("ward_id is not null")
    placed = placed.join(_frame(t).select("ward_id", "in_frame"), "ward_id")
    return placed.groupBy("in_frame").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ward_id").alias("wards"), F.avg("noise_db").alias("mean_db"))


@query("wards_outside_frame", oracle("select ward_id, ward from wards where kind <> 'phuong' and ward not in (select ward from built)", built=_FRAME))
def wards_outside_frame(t: Tables):
    """Complement of the sampling frame."""
    return _frame(t).where("not in_frame").select("ward_id", "ward")


# ------------------------------------------------------------------ roads of many vertices

_STRETCH = """select r.road_id, kind, site, place, b.x1, b.y1, b.x2, b.y2 from roads r join (select road_id, place, x as x1, y as y1,
 lead(x) over (partition by road_id order by place) as x2, lead(y) over (partition by road_id order by place) as y2 from bends) b on b.road_id = r.road_id where b.x2 is not null"""
_TO_STRETCH = f"""select px, py, road_id, kind, site, sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)) as d from
 (select p.x as px, p.y as py, road_id, kind, s.site, x1 + {_FOOT} * (x2 - x1) as fx, y1 + {_FOOT} * (y2 - y1) as fy from (select distinct x, y from meas) p, stretch s)"""
_WHOLE = "select road_id, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) as length_m from stretch group by 1"


@query("polyline_density", oracle(
    f"""select p.x, p.y, coalesce(len, 0) / 1000 / ({_AREA} / 1e6) as road_density_km_km2 from (select distinct x, y from meas) p
     left join (select px, py, sum(length_m) as len from (select distinct px, py, road_id from seg where d <= 300) t join whole using (road_id) group by 1, 2) g on g.px = p.x and g.py = p.y""",
    "x y road_density_km_km2", stretch=_STRETCH, seg=_TO_STRETCH, whole=_WHOLE))
def polyline_density(t: Tables):
    return features.road_density(t.meas, t.polylines)


@query("polyline_distances", oracle(
    """select px as x, py as y, min(d) as dist_road_m, min(d) filter (kind = 'major') as dist_highway_m, min(d) filter (kind = 'minor') as dist_residential_m from seg group by 1, 2""",
    "x y dist_road_m dist_highway_m dist_residential_m", stretch=_STRETCH, seg=_TO_STRETCH))
def polyline_distances(t: Tables):
    return features.road_distances(t.meas, t.polylines)


@query("polyline_corridor", oracle(
    """select road_id, site from roads r where road_id in (select road_id from near) or site not in (select site from near)""",
    stretch=_STRETCH, seg=_TO_STRETCH, near="select distinct s.road_id, s.site from seg s join (select distinct x, y, site from meas) m on m.x = s.px and m.y = s.py and m.site = s.site where s.d <= 150"))
def polyline_corridor(t: Tables):
    return polylines.corridor(t.polylines, t.meas, C.CORRIDOR_M).select("road_id", "site")


@query("polyline_clipped", oracle(
    """select road_id, zone, count(*) filter (not goes_on) as n_parts, round(sum((t1 - t0) * sqrt(dx * dx + dy * dy)), 3) as length_m from (
       select *, coalesce(t0 = 0 and lag(t1) over (partition by road_id, zone order by place) = 1 and lag(place) over (partition by road_id, zone order by place) = place - 1, false) as goes_on from (
       select road_id, place, z.site as zone, x2 - x1 as dx, y2 - y1 as dy,
         greatest(0, case when x2 > x1 then (x_lo - x1) / (x2 - x1) when x2 < x1 then (x_hi - x1) / (x2 - x1) else 0 end, case when y2 > y1 then (y_lo - y1) / (y2 - y1) when y2 < y1 then (y_hi - y1) / (y2 - y1) else 0 end) as t0,
         least(1, case when x2 > x1 then (x_hi - x1) / (x2 - x1) when x2 < x1 then (x_lo - x1) / (x2 - x1) else 1 end, case when y2 > y1 then (y_hi - y1) / (y2 - y1) when y2 < y1 then (y_lo - y1) / (y2 - y1) else 1 end) as t1
       from stretch r, zone z where (x1 <> x2 or x1 between x_lo and x_hi) and (y1 <> y2 or y1 between y_lo and y_hi)) where t0 < t1 and (dx <> 0 or dy <> 0)) group by 1, 2""",
    "length_m", stretch=_STRETCH, box=_BOX, zone=_ZONE))
def polyline_clipped(t: Tables):
    zones = _small_zones(t).withColumnRenamed("site", "zone")
    lengths = F.transform("lines", lambda part: geo.polyline_length(part))
    total = F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b)
    return polylines.clip_lines(t.polylines, zones, "road_id", "zone").select("road_id", "zone", F.size("lines").cast("bigint").alias("n_parts"), F.round(total, 3).alias("length_m"))
