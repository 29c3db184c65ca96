"""Every operator runs on frames of the declared table layouts, and odd inputs neither lose nor double rows."""

import pytest

from kickstand.operators import calibration as CA
from kickstand.operators import fleet as FL
from kickstand.operators import incidents as I
from kickstand.operators import status as ST
from kickstand.operators import tasks as TK
from kickstand.operators import trips as TR
from kickstand.plans import kpi as K
from kickstand.schemas import TABLES
from tests.conftest import at, day, tuples


@pytest.fixture(scope="module")
def t(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


CALLS = {
    "incident_features": lambda t: I.incident_features(t["incidents"]),
    "incidents_vs_expected": lambda t: I.incidents_vs_expected(t["incidents"], t["hourly_demand_by_vendor"].withColumn("area_type", CA.F.lit("campus"))),
    "status_sla": lambda t: ST.status_sla(t["status_changes"]),
    "status_flags": lambda t: ST.status_flags(t["status_changes"]),
    "workload_of_tasks": lambda t: TK.with_workload(t["tasks"], t["hourly_demand_by_vendor"], "created_at"),
    "workload_of_status": lambda t: TK.with_workload(t["status_changes"], t["hourly_demand_by_vendor"], "occurred_at"),
    "task_candidates": lambda t: TK.task_candidates(t["incidents"], t["status_changes"]),
    "task_linkage": lambda t: TK.task_linkage(t["tasks"], t["incidents"], t["status_changes"]),
    "task_timeline": lambda t: TK.task_timeline(t["tasks"]),
    "task_sla": lambda t: TK.task_sla(t["tasks"]),
    "vehicle_features": lambda t: FL.vehicle_features(t["vehicles"], "2024-01-01"),
    "trip_cost": lambda t: FL.trip_cost(t["trips_canon"], t["pricing_policies"]),
    "trip_cost_by_vendor_month": lambda t: FL.trip_cost_by_vendor_month(t["trips_canon"], t["pricing_policies"]),
    "sla_pct_status": lambda t: K.sla_pct_status(t["status_changes"]),
    "sla_pct_tasks": lambda t: K.sla_pct_tasks(t["tasks"]),
    "sla_matrix": lambda t: K.sla_matrix(t["tasks"], t["status_changes"], t["service_areas"]),
    "task_cost_total": lambda t: K.task_cost_total(t["tasks"]),
    "risk_vs_spend": lambda t: K.risk_vs_spend(t["incidents"], t["tasks"], t["hourly_demand_by_vendor"]),
    "cost_heatmap": lambda t: K.cost_heatmap(t["incidents"], t["tasks"], t["service_areas"]),
    "vendor_monthly": lambda t: K.vendor_monthly(t["hourly_demand_by_vendor"], t["incidents"], t["tasks"]),
    "task_funnel": lambda t: K.task_funnel(t["tasks"]),
    "events_count": lambda t: K.events_count(t["incidents"], t["status_changes"], t["tasks"]),
    "vehicle_drill_through": lambda t: K.vehicle_drill_through(t["vehicles"], t["incidents"], t["status_changes"]),
    "load_vs_handle": lambda t: K.load_vs_handle(t["status_changes"], t["hourly_demand_by_vendor"]),
    "expected_demand": lambda t: CA.expected_demand(t["hourly_demand_by_vendor"], t["service_areas"]),
}


@pytest.mark.parametrize("name", CALLS)
def test_operators_run_on_the_declared_layouts(name, t):
    assert CALLS[name](t).collect() is not None


def test_costs_are_the_stored_columns(spark):
    row = {"task_id": 1, "vendor": "Lyft", "task_type": "repair", "status": "done", "created_at": at("2024-01-05 08:30:00"), "response_minutes": 1, "work_minutes": 1, "cost_usd": 12.5, "parts_cost_usd": 2.0}
    tasks = spark.createDataFrame([tuple(row.get(f.name) for f in TABLES["tasks"])], TABLES["tasks"])
    assert tuples(K.task_cost_total(tasks)) == [("Lyft", day("2024-01-01"), 12.5, 2.0, 14.5)]


def test_large_sums_do_not_overflow(rows):
    events = rows("occurred_at timestamp_ntz, service_area_id int, vendor string, handle_minutes int", *[(at("2024-01-05 08:30:00"), 1, "Lyft", 4)] * 3)
    demand = rows("day date, hour int, service_area_id int, vendor string, trips bigint", (day("2024-01-05"), 8, 1, "Lyft", 10**15))
    assert tuples(K.load_vs_handle(events, demand)) == [("Lyft", 1, 3, 1e15, 4.0)]


def test_areas_that_differ_in_case_are_one(rows):
    canon = rows("vendor string, day date, hour int, area_name string, area_num int",
                 *[("Lyft", day("2024-01-05"), 8, name, None) for name in ("Loop", "LOOP", " loop", "Hyde Park", None)])
    catalog = CA.area_catalog(canon)
    assert catalog.count() == 2 and {r["area_key"] for r in catalog.collect()} == {"loop", "hyde park"}
    assert sum(r["trips"] for r in TR.canon_hourly(canon, catalog).collect()) == 5


def test_ambiguous_dimension_rows_are_an_error(rows):
    demand = rows("day date, hour int, service_area_id int, vendor string, trips bigint", (day("2024-01-05"), 8, 1, "Lyft", 5))
    same = rows("service_area_id int, community_area_name string, area_type string", (1, "A", "campus"), (1, "A", "campus"))
    assert TR.with_area_type(demand, same).count() == 1
    other = same.unionByName(rows("service_area_id int, community_area_name string, area_type string", (1, "A", "downtown")))
    for build in (lambda: TR.with_area_type(demand, other), lambda: CA.expected_demand(demand, other)):
        with pytest.raises(Exception, match="several rows of area 1"):
            build().collect()


@pytest.mark.parametrize("text", ["7/1/2024 8:05", "07/01/2024 08:05", "7/1/2024 8:05:00 AM", "2024-07-01 08:05:00"])
def test_times_with_and_without_leading_zeros(rows, text):
    from kickstand.functions import columns as X

    assert tuples(rows("x string", (text,)).select(X.parse_time("x"))) == [(at("2024-07-01 08:05:00"),)]
