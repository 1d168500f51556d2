"""Physical plans: no nested loops, pruned scans, partial limits before shuffles."""

import pytest
from pyspark.sql import functions as F

from soundfield.plans import QUERIES
from soundfield.plans.tables import Tables

SPATIAL = ["video_match", "disc_morphology", "neighbour_counts", "road_density", "road_distances", "eight_nearest", "points_in_wards", "points_in_zones",
           "roads_clipped", "buildings_clipped", "corridor_roads", "cell_lookup", "construction_energies", "near_source_mean", "noise_ceiling"]


# one-row tables must come in as scalars
SCALAR = ["heat_normalised", "campaign_headline", "class_levels", "density_by_period", "clip_flags", "flow_kpis", "hours_filled", "buffered_means", "group_split"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPATIAL + SCALAR)
def test_no_nested_loops(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns_only(spark, small):
    text = plan(Tables(spark, small).obs.where("noise_db > 60").select("obs_id", "noise_db"))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    assert "PushedFilters: [IsNotNull(value)" in text


def test_dedup_is_limited_before_the_shuffle(spark, small):
    text = plan(Tables(spark, small).meas)
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_no_row_based_python(spark, small):
    for name in ("exceedance_table", "line_crossings", "road_distances", "scenario_indicators"):
        text = plan(QUERIES[name](spark, small))
        assert "Python" not in text and "InPandas" not in text


def test_level_aggregation_is_partial(spark, small):
    text = plan(QUERIES["equivalent_levels"](spark, small))
    assert "partial_avg" in text


def test_one_job_reads_tables_of_any_folder(spark, small):
    assert Tables(spark, small + "/").wards.agg(F.count(F.lit(1))).first()[0] == 25
