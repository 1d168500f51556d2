"""Input tables: the given parquet files seen as survey, street and video data.

Each projection is one SQL text that Spark and the DuckDB oracle both run over
the whole table.  Positions are whole metres in a UTM-48N-like plane with three
study areas; the data is synthetic and says nothing about noise.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundfield.functions import survey
from soundfield.operators.cleaning import assign_site, clean
from soundfield.operators.grid import expand_hours, grid_cells, grid_layout
from soundfield.operators.shapes import rectangle_ring, square_ring

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CENTRES = [(f"site{i}", 584000.0 + 12000.0 * i, 2323000.0) for i in range(3)]
MAJOR = ("site0", "site1")
IMAGE = (1000.0, 1000.0)
AGAIN = 10**12  # added to the number of a measurement that is told twice

# {since} is the engine's "microseconds since 2024-01-01" of a timestamp
PROJECTIONS = {
    "obs": """
select event_id as seq, event_id as obs_id, ts, {since_ts} as ts_us,
 'c' || cast(user_id % 3 as string) as collector,
 case event_id % 4 when 0 then cast(null as string) when 1 then '  ' else 'u' || cast(user_id as string) end as contributor_id,
 case when k % 10 = 0 then cast(null as int) else k end as accuracy,
 40 + value / 4 as noise_db,
 case when event_type = 'error' then 'Construction noise' else event_type end as class,
 case k % 6 when 0 then '0-2 m' when 1 then '2-10 m' when 2 then '10-30 m' when 3 then '30-60 m' when 4 then '> 60 m' end as dist_to_road,
 'site' || cast((user_id + case when event_id % 17 = 0 then 1 else 0 end) % 3 as string) as site,
 cast(580000 + (user_id % 3) * 12000 + (event_id * 7919) % 8000 as double) as x,
 cast(2320000 + (event_id * 104729) % 6000 as double) as y
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e""",
    "roads": """
select p_partkey as road_id, case when p_type in ('LARGE','PROMO') then 'primary' when p_type = 'MEDIUM' then 'tertiary' else 'residential' end as highway,
 case when p_type in ('LARGE','PROMO') then 'major' else 'minor' end as kind,
 'site' || cast(p_partkey % 3 as string) as site,
 cast(x0 as double) as x1, cast(y0 as double) as y1, cast(x0 + (p_size * 37) % 401 - 200 as double) as x2, cast(y0 + (p_size * 53) % 401 - 200 as double) as y2
from (select *, 580000 + (p_partkey % 3) * 12000 + (p_partkey * 3571) % 8000 as x0, 2320000 + (p_partkey * 2711) % 6000 as y0 from part) p""",
    "bends": """
select p_partkey as road_id, i as place,
 cast(580000 + (p_partkey % 3) * 12000 + (p_partkey * 3571) % 8000 + (i * ((p_size * 37) % 81 - 40) + (p_partkey * (i + 1) * 31) % 61 - 30) * stretch as double) as x,
 cast(2320000 + (p_partkey * 2711) % 6000 + (i * ((p_size * 53) % 81 - 40) + (p_partkey * (i + 2) * 43) % 61 - 30) * stretch as double) as y
from (select *, case when p_partkey % 50 = 0 then 40 else 1 end as stretch from part) p
join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) as v(i) on i <= 2 + p_partkey % 8""",
    "buildings": """
select c_custkey as bld_id, cast(580000 + (c_custkey % 3) * 12000 + (c_custkey * 6007) % 8000 as double) as cx,
 cast(2320000 + (c_custkey * 4111) % 6000 as double) as cy, sqrt(50 + abs(c_acctbal) / 10) as side_m from customer""",
    "nodes": """
select s_suppkey as node_id, cast(580000 + (s_suppkey % 3) * 12000 + (s_suppkey * 5003) % 8000 as double) as x,
 cast(2320000 + (s_suppkey * 3001) % 6000 as double) as y from supplier""",
    "videos": """
select o_orderkey as video_id, cast((o_orderkey * 1789) % 2592000 as bigint) as start_s,
 cast((o_orderkey * 1789) % 2592000 as bigint) * 1000000 as start_us,
 cast(15 + o_orderkey % 20 as double) as duration_s, (15 + o_orderkey % 20) * 10 as n_frames from orders""",
    "detections": """
select l_orderkey - l_orderkey % 40 as video_id, l_partkey % 40 as track_id, l_orderkey * 10 + l_linenumber as frame,
 case l_returnflag when 'A' then 'car' when 'N' then 'moto' else 'truck' end as cls,
 l_quantity * 20 as cx, l_discount * 10000 as cy, l_suppkey as sub from lineitem""",
    "weather": """
select site, hour_i, cast(20 + (hour_i * 7 + site_i * 3) % 13 as double) as temperature_2m, cast((hour_i * 5 + site_i) % 9 as double) as wind_speed_10m,
 case when (hour_i * 11 + site_i) % 4 = 0 then 1.5e0 else 0e0 end as precipitation
from (select distinct 'site' || cast(user_id % 3 as string) as site, user_id % 3 as site_i, {since_ts_hours} as hour_i from events) g""",
    "wards": """
select n_nationkey as ward_id, n_name as ward, case when n_nationkey % 2 = 0 then 'phuong' else 'xa' end as kind,
 cast(580000 + (n_nationkey % 5) * 6400 as double) as x_lo, cast(2320000 + floor(n_nationkey / 5) * 1200 as double) as y_lo, 6400e0 as w, 1200e0 as h from nation""",
    "sources": """
select s_suppkey as src_id, cast(580000 + (s_suppkey % 3) * 12000 + (s_suppkey * 4999) % 8000 as double) as x, cast(2320000 + (s_suppkey * 2003) % 6000 as double) as y,
 case when s_acctbal > 5000 then 1 else 0 end as loud from supplier""",
}

SPARK_WORDS = {
    "since_ts": "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)",
    "since_ts_hours": "cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3600000000) as bigint)",
}
DUCK_WORDS = {
    "since_ts": "date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts)",
    "since_ts_hours": "cast(floor(date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts) / 3600000000) as bigint)",
}


class Tables:
    """Lazily built DataFrames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _project(self, name: str) -> DataFrame:
        text = PROJECTIONS[name].format(**SPARK_WORDS)
        used = [r for r in RAW if f"from {r}" in text]
        for table in used:
            self.raw(table).createOrReplaceTempView(table)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            return self._project(name)
        raise AttributeError(name)

    @cached_property
    def meas(self) -> DataFrame:
        """Clean measurements; one person counts once per instant (a tenth of them are told twice)."""
        again = self.obs.where("obs_id % 10 = 3").withColumns({"seq": F.col("seq") + AGAIN, "x": F.col("x") + 1})
        rows = clean(
            self.obs.unionByName(again), time="ts", position=("x", "y"), dedup_time=F.col("ts"), offsets={"c0": 1.5}
        )
        rows = rows.withColumn("who", survey.dedup_key(F.col("contributor_id"), F.col("collector")))
        return assign_site(rows, CENTRES, "x", "y")

    @cached_property
    def located(self) -> DataFrame:
        """Clean measurements with made-up degrees around the study area."""
        return self.meas.withColumn("latitude", 21 + (F.col("y") - 2323000.0) / 110540.0).withColumn(
            "longitude", 105.85 + (F.col("x") - 596000.0) / 104000.0
        )

    @cached_property
    def building_points(self) -> DataFrame:
        return self.buildings.select(
            F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("side_m") * F.col("side_m")).alias("area_m2")
        )

    @cached_property
    def building_rings(self) -> DataFrame:
        return self.buildings.withColumn("ring", square_ring(F.col("cx"), F.col("cy"), F.col("side_m")))

    @cached_property
    def polylines(self) -> DataFrame:
        """Roads of three to ten vertices with a list of tags; one in fifty has pieces forty times as long."""
        bends = self.bends.groupBy("road_id").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("v"))
        lines = bends.select("road_id", F.transform("v", lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"))).alias("line"))
        tagged = self.roads.select("road_id", "site", F.array("highway", F.lit("secondary")).alias("highway"))
        return tagged.join(lines, "road_id").withColumn("kind", survey.road_class(F.col("highway")))

    @cached_property
    def ward_rings(self) -> DataFrame:
        ring = rectangle_ring(F.col("x_lo"), F.col("y_lo"), F.col("x_lo") + F.col("w"), F.col("y_lo") + F.col("h"))
        return self.wards.select("ward_id", "ward", "kind", ring.alias("ring"))

    @cached_property
    def ward_areas(self) -> DataFrame:
        """Wards of two parts with a hole: a box less a diamond in its middle, and a smaller diamond inside the next box's hole."""
        def diamond(cx, cy, a, b):
            corners = [(cx - a, cy), (cx, cy - b), (cx + a, cy), (cx, cy + b)]
            return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])

        x, y, w, h = (F.col(c) for c in ("x_lo", "y_lo", "w", "h"))
        hole = diamond(x + w / 2 + 0.25, y + h / 2 + 0.25, w / 4 + 0.1, h / 4 + 0.1)
        island = diamond(x + 1.5 * w + 0.25, y + h / 2 + 0.25, w / 8 + 0.1, h / 8 + 0.1)
        return self.wards.select("ward_id", "ward", "kind", F.array(rectangle_ring(x, y, x + w, y + h), hole, island).alias("rings"))

    @cached_property
    def layout(self) -> DataFrame:
        return grid_layout(self.meas)

    @cached_property
    def grid(self) -> DataFrame:
        """Grid rows with a simple made-up level and distances, for lookup and scenario queries."""
        return self.dress(grid_cells(self.layout))

    @staticmethod
    def dress(cells: DataFrame) -> DataFrame:
        return expand_hours(cells).select(
            "*", (40.0 + (F.col("ix") * 7 + F.col("iy") * 13 + F.col("hour") * 3) % 41).alias("level_db"),
            (1.0 + F.col("ix") * 11 % 300).alias("d_hw"), (1.0 + F.col("iy") * 17 % 400).alias("d_res"),
        )


# ------------------------------------------------------------------------------ oracle side

_MEAS = """
select o.* exclude (site, noise_db, rn), noise_db + case when collector = 'c0' then 1.5e0 else 0e0 end as noise_db, site as site_declared,
 case when (x-584000)*(x-584000) <= (x-596000)*(x-596000) and (x-584000)*(x-584000) <= (x-608000)*(x-608000) then 'site0'
      when (x-596000)*(x-596000) <= (x-608000)*(x-608000) then 'site1' else 'site2' end as site,
 cast(extract(hour from ts) as int) as hour, case when extract(isodow from ts) >= 6 then 1 else 0 end as is_weekend, dayname(ts) as day_of_week
from (select *, coalesce(nullif(trim(contributor_id), ''), collector) as who,
        row_number() over (partition by coalesce(nullif(trim(contributor_id), ''), collector), ts order by seq) as rn
      from (select * from obs union all select * replace (seq + 1000000000000 as seq, x + 1 as x) from obs where obs_id % 10 = 3) told where noise_db is not null and x is not null and y is not null) o
where rn = 1 and (accuracy is null or accuracy < 50) and noise_db >= 20 and noise_db <= 120"""

_LAYOUT = """
select site, min(x) - 400 as x0, min(y) - 400 as y0, 40e0 as step,
 cast(ceil((max(x) - min(x) + 800) / 40) as bigint) as nx, cast(ceil((max(y) - min(y) + 800) / 40) as bigint) as ny
from meas group by site"""

_CELLS = """
select site, ix, iy, x0 + ix * step as x, y0 + iy * step as y
from (select *, unnest(range(0, nx)) as ix from layout) a, lateral (select unnest(range(0, a.ny)) as iy) b"""

_GRID = """
select c.*, cast(h.hour as int) as hour, cast(40 + (ix * 7 + iy * 13 + h.hour * 3) % 41 as double) as level_db,
 cast(1 + ix * 11 % 300 as double) as d_hw, cast(1 + iy * 17 % 400 as double) as d_res
from cells c, (select unnest(range(5, 22)) as hour) h"""


def oracle(body: str, doubles: str = "", **ctes: str) -> str:
    """DuckDB text: projections and shared tables as CTEs, extra CTEs, rounded doubles."""
    parts = [(n, t.format(**DUCK_WORDS)) for n, t in PROJECTIONS.items()]
    parts += [("meas", _MEAS), ("layout", _LAYOUT), ("cells", _CELLS), ("grid", _GRID)]
    parts += [
        ("located", "select *, 21 + (y - 2323000e0) / 110540e0 as latitude, 105.85e0 + (x - 596000e0) / 104000e0 as longitude from meas"),
    ]
    parts += list(ctes.items())
    text = "with recursive " + ",\n".join(f"{n} as ({t.strip()})" for n, t in parts)
    names = doubles.split()
    if not names:
        return f"{text}\n{body}"
    rounded = ", ".join(f"round({n} + {NUDGE:.0e}, 6) + 0e0 as {n}" for n in names)
    return f"{text}\nselect * replace ({rounded}) from ({body}) final_rows"


# means of short decimals end in exact halves; both engines move them off the tie
NUDGE = 3e-8


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to six decimals, as the oracle does; no negative zero."""
    return df.select(*[
        (F.round(F.col(f"`{n}`") + NUDGE, 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes
    ])
