"""Physical plans: what reaches the scan, what is shuffled, and what must never appear."""

import re

import pytest

from kickstand.operators import maintenance as M
from kickstand.operators import trips as TR
from kickstand.plans.catalog import all_queries
from kickstand.schemas import TABLES
from tests.compare import DATA
from tests.conftest import at

SF_DIR = str(DATA / "sf0.001")
QUERIES = all_queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_join(name, spark):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin", "LocalTableScan"):
        assert node not in plan, f"{name}: {node}"


@pytest.fixture(scope="module")
def trips(spark, tmp_path_factory):
    """A real trips table, as a user has it: filters can reach its parquet columns."""
    path = str(tmp_path_factory.mktemp("trips") / "t")
    row = ("Lyft", at("2024-01-01 08:00:00"), 600, 2000, 1)
    spark.createDataFrame([row], TABLES["trips_canon"]).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(trips):
    plan = plan_of(TR.avg_trips_by_vendor(trips))
    assert "GreaterThan(duration_s,60)" in plan and "LessThanOrEqual(distance_m,20000)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "service_area_id" not in schema
    daily = plan_of(TR.daily_trips_by_vendor(trips, start="2024-01-01"))
    assert "IsNotNull(vendor)" in daily and "GreaterThanOrEqual(started_at" in daily
    assert re.search(r"ReadSchema: struct<vendor:string,started_at:timestamp_ntz>", daily)


@pytest.mark.parametrize("build", [TR.daily_trips_by_vendor, TR.avg_trips_by_vendor, TR.hourly_demand_by_vendor])
def test_ordered_trip_reports_take_two_shuffles(build, trips):
    plan = plan_of(build(trips))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"Exchange rangepartitioning", plan)) == 1
    assert "partial_count" in plan


def test_pickup_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame(
        [(1, "a", "maintenance_pickup", at("2024-01-01 08:00:00"))],
        "event_id bigint, vehicle_id string, event_type string, event_time timestamp_ntz",
    ).write.parquet(path)
    status = spark.read.parquet(path)
    assert "EqualTo(event_type,maintenance_pickup)" in plan_of(M.service_events_per_day(status))
    assert "In(event_type, [maintenance_dropoff,maintenance_pickup])" in plan_of(M.avg_downtime_per_vehicle(status))
