"""Registered queries against their SQL on the smallest tables, and plan checks."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = (
    "c1_service_days", "d4_routes_without", "d9_connections", "d10_travel_times", "d13_direct_trips", "e11_distance_totals",
    "e40_patterns_per_route", "f1_headways", "f4_segment_speeds", "f9_trips_at_once", "s2_nearest_stops",
    "s7_spacing_along_shapes", "n1_fuzzy_stops", "r4_cosine_top_k", "a1_stops_from_csv", "a2_stop_times_from_csv", "v3_orphans",
    "c2_stop_times_norm", "c3_departures", "c4_trip_start_times", "f15_longest_shared_sequences", "v1_not_null", "v6_local_time",
    "answer_5_busiest_date", "answer_7_stops_at_intersection", "answer_9_trips_after_midnight", "answer_28_routes_at_stop_id",
    "answer_34_stops_by_name", "answer_54_weekend_distance",
)
KEYS = tuple(k for k in entry.queries() if k not in entry.LLM_QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("key", KEYS)
def test_equal_to_sql(spark, con, key):
    line = compare.compare(spark, con, key, SF_DIR)
    assert line.startswith(("ok", "rows")), line


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["gtfs_id", "service_date", "trips"] and df.count() == 5


# Training-data operators may run Python and have tests of their own.
PLANNED = [k for k in entry.queries() if k not in entry.LLM_QUERIES]


@pytest.mark.parametrize("key", PLANNED)
def test_plans_have_no_cross_join_and_no_python(spark, key):
    plan = entry.queries()[key](spark, SF_DIR)._jdf.queryExecution().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in plan, node
