"""Queries over traffic, mitigation and construction scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions import levels
from soundfield.operators import scenario
from soundfield.operators.grid import grid_cells
from soundfield.operators.scenario import Scenario
from soundfield.plans.registry import query
from soundfield.plans.spatial import _DIST
from soundfield.plans.tables import Tables, oracle

SCENARIOS = (
    Scenario("base"), Scenario("triple", 3.0), Scenario("zone30", 1.0, "zone30"), Scenario("pedestrian", 1.0, "pedestrian"),
)
_A_HW, _A_RES = C.PUBLISHED_KERNEL["a_hw"], C.PUBLISHED_KERNEL["a_res"]

_AMBIENT = "select site, hour, level_db as ambient_db from (select *, row_number() over (partition by site, hour order by level_db) - 1 as i, count(*) over (partition by site, hour) as n from grid) where i = least(floor(n * 0.05), n - 1)"
_SHARE = "(4.774e7 / greatest(d_hw, 5)) / (4.774e7 / greatest(d_hw, 5) + 3.8e7 / greatest(d_res, 5))"
_PARTS = f"""select g.*, least(pow(10e0, ambient_db / 10), pow(10e0, level_db / 10)) as e_amb, (pow(10e0, level_db / 10) - least(pow(10e0, ambient_db / 10), pow(10e0, level_db / 10))) as e_traffic, {_SHARE} as share
 from grid g join ambient a on a.site = g.site and a.hour = g.hour"""
_SC = """select p.*, scenario, 10 * log10(e_amb + k * e_traffic * share + kl * e_traffic * (1 - share)) as background_db from
 (select p.*, scenario, k, case when m = 'zone30' and d_res <= 150 then k * pow(10e0, -0.3e0) when m = 'pedestrian' then k * 0.2e0 else k end as kl
  from parts p, (values ('base', 1e0, 'none'), ('triple', 3e0, 'none'), ('zone30', 1e0, 'zone30'), ('pedestrian', 1e0, 'pedestrian')) s(scenario, k, m)) p"""
_CTES = {"ambient": _AMBIENT, "parts": _PARTS, "sc": _SC}


def _share():
    return scenario.major_share(F.col("d_hw"), F.col("d_res"), _A_HW, _A_RES)


@query("zone_ambience", oracle("select * from ambient", "ambient_db", ambient=_AMBIENT))
def zone_ambience(t: Tables):
    return scenario.ambience(t.grid)


@query("major_road_share", oracle(f"select site, avg(share) as mean_share, min(share) as min_share, max(share) as max_share from (select site, {_SHARE} as share from grid) group by 1", "mean_share min_share max_share"))
def major_road_share(t: Tables):
    return t.grid.groupBy("site").agg(F.avg(_share()).alias("mean_share"), F.min(_share()).alias("min_share"), F.max(_share()).alias("max_share"))


@query("energy_parts", oracle(
    "select site, hour, 10 * log10(sum(e_amb)) as ambient_db, 10 * log10(sum(e_traffic * share)) as major_db, 10 * log10(sum(e_traffic * (1 - share))) as minor_db from parts group by 1, 2",
    "ambient_db major_db minor_db", ambient=_AMBIENT, parts=_PARTS))
def energy_parts(t: Tables):
    parts = scenario.decompose(t.grid, _share())
    db = lambda c: (10 * F.log10(F.sum(c)))
    return parts.groupBy("site", "hour").agg(db("e_ambient").alias("ambient_db"), db("e_major").alias("major_db"), db("e_minor").alias("minor_db"))


_CONSTRUCTION = f"""select a.x, a.y, sum(pow(10e0, (64.7e0 - 20 * log10(greatest({_DIST}, 25) / 56e0)) / 10)) as ce from (select distinct x, y from cells) a join sources b on {_DIST} <= 250 group by 1, 2"""
_EFFECTIVE = "select s.*, 10 * log10(pow(10e0, background_db / 10) + case when hour between 8 and 17 then coalesce(ce, 0) else 0 end) as effective_db from sc s left join con c on c.x = s.x and c.y = s.y"


@query("scenario_indicators", oracle(
    """select scenario, site, hour, count(*) as cells, avg(effective_db) as mean_db, max(effective_db) as peak_db, 100e0 * avg(case when effective_db > 70 then 1e0 else 0e0 end) as pct_over_day,
       100e0 * avg(case when effective_db > 55 then 1e0 else 0e0 end) as pct_over_night, avg(background_db - level_db) as mean_shift_db from eff group by 1, 2, 3""",
    "mean_db peak_db pct_over_day pct_over_night mean_shift_db", **_CTES, con=_CONSTRUCTION, eff=_EFFECTIVE))
def scenario_indicators(t: Tables):
    """Four scenarios with construction work from 8 to 17 h, per zone and hour."""
    rows = t.dress(scenario.with_construction(grid_cells(t.layout), t.sources))
    rows = scenario.apply_scenarios(scenario.decompose(rows, _share(), scenario.ambience(t.grid)), SCENARIOS)
    return scenario.zone_indicators(scenario.overlay_construction(rows, 8, 17))


@query("unchanged_at_one", oracle(
    "select count(*) as n, count(*) filter (abs(background_db - level_db) > 1e-6) as moved from sc where scenario = 'base'", **_CTES))
def unchanged_at_one(t: Tables):
    """At factor one without mitigation every level must stay."""
    rows = scenario.apply_scenarios(scenario.decompose(t.grid, _share()), SCENARIOS[:1])
    moved = (F.abs(F.col("background_db") - F.col("level_db")) > 1e-6).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(moved).alias("moved"))


@query("traffic_scaling", oracle(
    """select site, hour, k, avg(10 * log10(e_amb + k * e_traffic) - level_db) as mean_shift_db from parts, (select unnest([0.2e0, 1e0, 3e0]) as k) ks group by 1, 2, 3""",
    "k mean_shift_db", ambient=_AMBIENT, parts=_PARTS))
def traffic_scaling(t: Tables):
    rows = t.grid.join(scenario.ambience(t.grid), ["site", "hour"]).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0.2, 1.0, 3.0)])))
    scaled = scenario.scaled_level(F.col("level_db"), F.col("k"), levels.to_energy(F.col("ambient_db")))
    return rows.groupBy("site", "hour", "k").agg(F.avg(scaled - F.col("level_db")).alias("mean_shift_db"))
