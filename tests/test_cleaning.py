"""Hand-made survey rows: keys, bounds, offsets, privacy, rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from soundfield.functions import geo, levels, survey, timing
from soundfield.functions.numbers import rounded
from soundfield.operators import cleaning, energy

T1 = dt.datetime(2026, 8, 20, 17, 30, 0, 100000)
T2 = dt.datetime(2026, 8, 20, 17, 30, 0, 200000)
SCHEMA = ("seq int, timestamp timestamp_ntz, latitude double, longitude double, accuracy double, noise_db double, class string, "
          "site string, collector string, contributor_id string, dist_to_road string")


def rows(spark, *given):
    base = dict(timestamp=T1, latitude=21.0317, longitude=105.8514, accuracy=4.9, noise_db=70.0, **{"class": "Transportation noise"},
                site="Hoan Kiem lake", collector="ann", contributor_id=None, dist_to_road="0-2 m")
    names = [p.strip().split(" ")[0] for p in SCHEMA.split(",")]
    data = [tuple({**base, **g, "seq": i}[n] for n in names) for i, g in enumerate(given)]
    return spark.createDataFrame(data, SCHEMA)


def test_one_person_counts_once_per_instant(spark):
    assert cleaning.clean(rows(spark, {}, {}, {"collector": "bob"})).count() == 2


def test_two_contributors_stay_apart(spark):
    got = cleaning.clean(rows(spark, {"collector": "public", "contributor_id": "aaa"}, {"collector": "public", "contributor_id": "bbb"}))
    assert got.count() == 2


def test_contributor_twice(spark):
    p = {"collector": "public", "contributor_id": "aaa"}
    assert cleaning.clean(rows(spark, p, p, {**p, "timestamp": T2})).count() == 2


def test_mixed_keys(spark):
    df = rows(spark, {}, {"collector": "public", "contributor_id": "aaa"}, {"collector": "public", "contributor_id": "  "})
    keys = [r[0] for r in df.orderBy("seq").select(survey.dedup_key(F.col("contributor_id"), F.col("collector"))).collect()]
    assert keys == ["ann", "aaa", "public"]


def test_first_row_wins_and_dedup_precedes_bounds(spark):
    got = cleaning.clean(rows(spark, {"noise_db": 19.0}, {"noise_db": 70.0}))
    assert got.count() == 0


def test_bounds(spark):
    p = [{"noise_db": v, "collector": f"c{i}"} for i, v in enumerate((19.0, 121.0, 70.0))]
    assert [r.noise_db for r in cleaning.clean(rows(spark, *p)).collect()] == [70.0]


def test_offset_follows_bounds(spark):
    df = rows(spark, {}, {"collector": "public"}, {"collector": "bob", "noise_db": 119.5})
    got = {r.collector: r.noise_db for r in cleaning.clean(df, offsets={"ann": 1.5, "bob": 2.0}).collect()}
    assert got == {"ann": 71.5, "public": 70.0, "bob": 121.5}


def test_people_are_never_published(spark):
    got = cleaning.published(cleaning.clean(rows(spark, {})))
    assert not {"collector", "contributor_id", "note"} & set(got.columns)


def test_accuracy_rules(spark):
    df = rows(spark, {"accuracy": None}, {"accuracy": 50.0, "collector": "b"}, {"collector": "c"})
    assert cleaning.clean(df).count() == 2
    assert cleaning.clean(df, strict=True).count() == 1


def test_site_is_the_nearest_centre(spark):
    from soundfield.config import SITE_CENTRES

    df = cleaning.assign_site(rows(spark, {"site": "Ocean Park"}, {"collector": "b"}), SITE_CENTRES)
    assert [r.site for r in df.orderBy("seq").collect()] == ["Hoan Kiem lake"] * 2
    assert cleaning.site_corrections(df).count() == 1


def test_outside_every_site(spark):
    from soundfield.config import SITE_CENTRES

    df = rows(spark, {}, {"latitude": 21.2, "collector": "b"})
    got = df.orderBy("seq").select(cleaning.centre_or_outside(F.col("latitude"), F.col("longitude"), SITE_CENTRES).alias("c")).collect()
    assert [r.c.outside for r in got] == [False, True]


def test_standardize_is_loud_about_positions_and_quiet_about_counts(spark):
    text = spark.createDataFrame(
        [("2026-06-22T06:27:00.5+00:00", "21.03", "105.85", "70", " ANN ", "d_0_2", "many", "Construction noise")],
        "timestamp string, latitude string, longitude string, noise_db string, collector string, dist_to_road string, count_cars string, class string")
    r = cleaning.standardize(text).first()
    assert (r.timestamp, r.collector, r.dist_to_road, r.count_cars) == (dt.datetime(2026, 6, 22, 13, 27, 0, 500000), "ann", "0-2 m", None)
    assert (r.phone_orientation, r.mic_to_source, r.construction_nearby) == ("horizontal", "towards", "yes")
    with pytest.raises(Exception):
        cleaning.standardize(text.withColumn("noise_db", F.lit("loud"))).collect()


def test_rules(spark):
    rules = [survey.Rule("a", "decimal", required=True, low=0, high=10), survey.Rule("b", "integer"), survey.Rule("c", "choice", choices=("x",))]
    df = spark.createDataFrame([("3,5", "", "x"), (" ", "1.5", "y"), ("11", None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(survey.violations(rules)).collect()]
    assert got == [[], ["a:required", "b:type", "c:choice"], ["a:range"]]


def test_names_and_places(spark):
    df = spark.range(1).select(
        timing.video_start(F.lit("IMG_20260622_062700.mov")).alias("start"), timing.video_start(F.lit("clip.mov")).alias("none"),
        timing.iso6709_latitude(F.lit("+21.0317+105.8514+010/")).alias("lat"), timing.iso6709_longitude(F.lit("+21.0317+105.8514/")).alias("lon"),
        timing.geopoint_part(F.lit("21.1 105.2 7 4.5"), 4).alias("acc"), timing.geopoint_part(F.lit("21.1 105.2"), 4).alias("no_acc"),
        survey.is_development(F.lit("KHU ĐÔ THỊ mới")).alias("dev"), survey.is_development(F.lit("Chợ")).alias("shop"),
        survey.unit_kind(F.lit("Phường X")).alias("ward"), survey.unit_kind(F.lit("Xã Y")).alias("commune"),
        survey.road_class(F.array(F.lit("tertiary"), F.lit("primary"))).alias("minor"), survey.road_class(F.array(F.lit("trunk_link"))).alias("major"),
        rounded(F.lit(2.5)).alias("even"), rounded(F.lit(0.125), 2).alias("even2"),
    )
    r = df.first()
    assert r.start == dt.datetime(2026, 6, 22, 6, 27) and r.none is None
    assert (r.lat, r.lon, r.acc, r.no_acc) == (21.0317, 105.8514, 4.5, None)
    assert (r.dev, r.shop, r.ward, r.commune, r.minor, r.major, r.even, r.even2) == (True, False, "phuong", "xa", "minor", "major", 2.0, 0.12)


def test_cyclic_hour_and_levels(spark):
    h = lambda v: (timing.hour_sin(F.lit(v)), timing.hour_cos(F.lit(v)))
    (s23, c23), (s0, c0) = h(23), h(0)
    r = spark.range(1).select(
        F.hypot(s23 - s0, c23 - c0).alias("d"), levels.to_level(F.lit(0.0)).alias("none"), levels.to_level_floored(F.lit(0.0)).alias("floor"),
        levels.to_level(levels.to_energy(F.lit(63.0))).alias("same"),
    ).first()
    assert r.d < 0.3 and r.none is None and r.floor == -90.0 and r.same == pytest.approx(63.0)


def test_utm_against_known_positions(spark):
    """Central meridian: easting 500 km; northing from the WGS-84 meridian arc."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    import numpy as np

    phi = np.linspace(0, np.radians(21.0), 200001)
    integrand = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = float(((integrand[1:] + integrand[:-1]) / 2 * np.diff(phi)).sum()) * 0.9996
    x, y = geo.utm_from_lonlat(F.lit(105.0), F.lit(21.0), 48)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(500000.0, abs=1e-6) and r.y == pytest.approx(arc, abs=1e-3)
    lon, lat = geo.lonlat_from_utm(F.lit(588000.0), F.lit(2326000.0), 48)
    x, y = geo.utm_from_lonlat(lon, lat, 48)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(588000.0, abs=1e-6), pytest.approx(2326000.0, abs=1e-6))


def test_phone_calibration(spark):
    df = spark.createDataFrame([("a", 70.0, 72.0, 0.0), ("a", 71.0, 73.5, 0.0), ("b", 60.0, 61.0, 1.0)], "device string, measured_db double, reference_db double, current_offset_db double")
    got = {r.device: r for r in energy.combine_calibrations(df).collect()}
    assert got["a"].offset_db == pytest.approx(2.25) and got["a"].agrees
    assert got["b"].offset_db == pytest.approx(2.0) and got["b"].spread_db == 0.0 and not got["b"].agrees


def test_gps_fusion(spark):
    df = spark.createDataFrame([("k", 0.0, 0.0, 5.0), ("k", 10.0, 10.0, 10.0), ("k", 900.0, 0.0, 100.0), ("k", 1.0, 1.0, 0.0)], "k string, x double, y double, accuracy double")
    r = energy.fuse_fixes(df, "k").first()
    assert (r.x, r.accuracy_m, r.n_used) == (pytest.approx(2.0), 5.0, 2)
