import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from soundfield.operators import cleaning, grid
from soundfield.sources import readers, writers

EXPORT = """start;Who is collecting?;_Location_latitude;_Location_longitude;_Location_precision;Noise level (dB);Noise category;Study site;Distance to nearest road;Cars passing
2026-06-22T06:27:00.000+07:00;Ann;21.0317;105.8514;4.9;70,5;Transportation noise;Ocean Park;d_0_2;3
2026-06-22T06:27:00.000+07:00;Ann;21.0317;105.8514;4.9;71.5;Transportation noise;Ocean Park;d_0_2;many
2026-06-23T01:00:00.000+07:00;Bob;20.9928;105.8690;80;66;Construction noise;Vinh Tuy area;d_2_10;
2026-06-23T02:00:00.000+07:00;Bob;20.9928;105.8690;;66;Construction noise;Vinh Tuy area;d_2_10;
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "export_2026-06-01.csv").write_text("start;x\nold;1\n")
    (tmp_path / "export_2026-06-30.csv").write_text(EXPORT.replace("70,5", "70.5"))
    (tmp_path / "z_measurements.csv").write_text("a,b\n1,2\n")
    (tmp_path / "zz_Construction_register.csv").write_text(
        "Type,_Construction site location_latitude,_Construction site location_longitude,Activity level today\n"
        "Tower,21.0,105.9,Active and LOUD\nRoad,oops,105.9,quiet\nRoad,21.1,105.8,quiet\n")
    return str(tmp_path)


def test_survey_export_to_published_csv(spark, folder, tmp_path):
    raw = readers.read_survey_export(spark, folder)
    assert raw.count() == 4 and "altitude" not in raw.columns
    from soundfield.config import SITE_CENTRES

    clean = cleaning.assign_site(cleaning.clean(cleaning.standardize(raw)), SITE_CENTRES)
    rows = clean.orderBy("timestamp").collect()
    assert [(r.noise_db, r.site, r.construction_nearby) for r in rows] == [(70.5, "Hoan Kiem lake", "no"), (66.0, "Vinh Tuy area", "yes")]
    assert rows[0].timestamp == dt.datetime(2026, 6, 22, 6, 27) and rows[0].count_cars == 3
    out = str(tmp_path / "published")
    writers.write_measurements(clean, out)
    back = readers.read_measurements(spark, out)
    assert back.count() == 2 and back.orderBy("timestamp").first().timestamp == rows[0].timestamp
    assert not {"collector", "contributor_id", "note"} & set(back.columns)


def test_column_resolution_prefers_keys_then_columns():
    titles = ["Study site", "my_site", "X_LATITUDE", "_latitude"]
    assert readers.resolve_column(titles, ("_latitude", "other")) == "X_LATITUDE"
    assert readers.resolve_column(titles, ("study site", "site")) == "Study site"
    assert readers.resolve_column(titles, ("absent",)) is None


def test_construction_register_with_commas(spark, folder):
    got = readers.read_construction_register(spark, folder).orderBy("latitude").collect()
    assert [(r.latitude, r.site_type, r.loud) for r in got] == [(21.0, "Tower", 1), (21.1, "Road", 0)]


def test_times_with_and_without_fraction(spark, tmp_path):
    (tmp_path / "m.csv").write_text("latitude,longitude,noise_db,timestamp,class\n1,2,60,2026-06-22 06:27:00.123,a\n1,2,60,2026-06-22T06:27:00,a\n")
    got = sorted(r.timestamp for r in readers.read_measurements(spark, str(tmp_path / "m.csv")).collect())
    assert got == [dt.datetime(2026, 6, 22, 6, 27), dt.datetime(2026, 6, 22, 6, 27, 0, 123000)]


def test_shards_read_only_named_columns(spark, small):
    df = readers.read_shards(spark, f"{small}/event*.parquet", ["event_id", "value"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_minute_levels_and_geojson_and_bytes(spark, tmp_path):
    (tmp_path / "2026_01.csv").write_text("Timestamp_local,Id_Instal,Nivell_LAeq_1min,Other\n2026-01-10T12:00:00+01:00,7,61.5,x\n2026-07-10T12:00:00+02:00,7,62.5,x\n")
    got = readers.read_minute_levels(spark, str(tmp_path / "*.csv")).orderBy("ts").collect()
    assert [(r.ts.hour, r.noise_db) for r in got] == [(12, 61.5), (12, 62.5)]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "n", "osm_id": 5}, "geometry": {"type": "Point", "coordinates": [105.8, 21.0]}}]}
    (tmp_path / "d.geojson").write_text(json.dumps(doc, indent=1))
    r = readers.read_geojson_features(spark, str(tmp_path / "d.geojson")).first()
    assert (r.properties.osm_id, r.coordinates[1], r.geometry_type) == (5, 21.0, "Point")
    (tmp_path / "a.ogg").write_bytes(b"abc")
    c = readers.read_clip_bytes(spark, str(tmp_path / "*.ogg")).first()
    assert (c.length, c.md5) == (3, "900150983cd24fb0d6963f7d28e17f72")


def test_noise_map_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5000.0, 0.0)], "site string, x double, y double")
    cells = grid.expand_hours(grid.grid_cells(grid.grid_layout(points, step=200.0)))
    rows = cells.select("*", (50 + F.col("hour")).cast("double").alias("level_db"), (F.col("x") / 1e5).alias("longitude"), (F.col("y") / 1e5).alias("latitude"))
    out = str(tmp_path / "map")
    writers.write_noise_map(rows, out)
    wide = spark.read.option("header", True).csv(f"{out}/wide")
    one = wide.where("site = 'a'")
    assert "PartitionFilters: [isnotnull(site" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() * 17 == rows.where("site = 'a'").count() and one.first().h5 == "55.0"
    flat = spark.read.option("header", True).csv(f"{out}/flat")
    assert flat.count() == wide.count() and set(r.hour for r in flat.collect()) == {"17"}


def test_small_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "site string, v double")
    writers.write_table(df, str(tmp_path / "t"))
    writers.write_table(df, str(tmp_path / "j"), "json")
    writers.write_features(df, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "j")).first().v == 1.5
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().v == "1.5"
    assert spark.read.parquet(str(tmp_path / "f")).first().v == 1.5
