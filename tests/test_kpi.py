"""Report measures on small inputs; whole-table results are checked by test_oracle."""

import pytest

from kickstand.operators.tasks import task_cost
from kickstand.plans import kpi as K
from tests.conftest import at, day, tuples

DEMAND = "day date, hour int, service_area_id int, vendor string, trips bigint"
TASKS = (
    "task_id bigint, vendor string, task_type string, status string, created_at timestamp_ntz, response_minutes int, "
    "work_minutes int, service_area_id int, move_km int, parts_cost_usd int"
)


@pytest.fixture(scope="module")
def demand(rows):
    return rows(DEMAND, (day("2024-01-05"), 8, 1, "Lyft", 600), (day("2024-01-06"), 9, 2, "Lime", 400),
                (day("2024-02-06"), 8, 2, "Lyft", 50))


@pytest.fixture(scope="module")
def tasks(rows):
    t = at("2024-01-05 08:30:00")
    return rows(TASKS, (1, "Lyft", "repair", "done", t, 10, 20, 1, 2, 5), (2, "Lyft", "repair", "open", t, 10, 20, 1, 2, 0),
                (3, "Lime", "rebalance", "done", t, 100, 100, 9, 5, 1), (4, None, "rebalance", "canceled", t, 7, 1, 2, 5, 1))


@pytest.fixture(scope="module")
def incidents(rows):
    return rows("incident_id bigint, vendor string, vehicle_id string, occurred_at timestamp_ntz, incident_type string, "
                "service_area_id int, cost_usd double",
                (1, "Lyft", "a", at("2024-01-05 08:30:00"), "crash", 1, 10.0),
                (2, "Lyft", "a", at("2024-01-06 08:30:00"), "theft", 1, 30.0),
                (3, "Spin", None, at("2024-03-05 08:30:00"), "crash", 7, 5.5))


def test_rates_keep_keys_of_both_sides(demand, incidents):
    got = sorted(tuples(K.incidents_per_1k_trips(incidents, demand)))
    assert got == [
        ("Lime", day("2024-01-01"), 0, 400, 0.0), ("Lyft", day("2024-01-01"), 2, 600, 3.3333),
        ("Lyft", day("2024-02-01"), 0, 50, 0.0), ("Spin", day("2024-03-01"), 1, 0, None),
    ]


def test_cube_totals_equal_plain_counts(tasks):
    got = {(v, k, va, ka): n for v, k, va, ka, n, *_ in tuples(K.task_measures_cube(tasks))}
    assert got[None, None, 1, 1] == 4
    assert got["Lyft", None, 0, 1] == 2 and got[None, "rebalance", 1, 0] == 2
    # a task without a vendor is told apart from the total over vendors
    assert got[None, "rebalance", 0, 0] == 1 and got[None, None, 0, 1] == 1


def test_sla_and_funnel(tasks):
    assert sorted(tuples(K.sla_pct_tasks(tasks)), key=str) == sorted(
        [("Lyft", "repair", 1, 1.0), ("Lime", "rebalance", 1, 0.0), (None, "rebalance", 0, None)], key=str)
    funnel = {r[:2]: r[2:] for r in tuples(K.task_funnel(task_cost(tasks)))}
    assert funnel["repair", "Lyft"] == (2, 1, 1, 1, 0, 10.0, 11.5)
    assert funnel["rebalance", None] == (1, 0, 1, 0, 1, 7.0, 9.0)


def test_heatmap_is_normalised_per_area_type(demand, rows):
    areas = rows("service_area_id int, community_area_name string, area_type string", (1, "x", "downtown"), (2, "y", "campus"))
    assert sorted(tuples(K.trips_heatmap(demand, areas))) == [
        (8, "campus", 50, 0.125), (8, "downtown", 600, 1.0), (9, "campus", 400, 1.0),
    ]
    assert sorted(tuples(K.trips_heatmap_wide(demand, areas))) == [(8, 600, 50, 0, 0), (9, 0, 400, 0, 0)]


def test_money(demand, incidents, tasks):
    assert tuples(K.cost_waterfall(incidents)) == [("theft", 1, 30.0, 30.0), ("crash", 2, 15.5, 45.5)]
    monthly = {r[:2]: r[2:] for r in tuples(K.vendor_monthly(demand, incidents, task_cost(tasks)))}
    assert monthly[day("2024-01-01"), "Lyft"] == (600, 40.0, 23.0)
    assert monthly[day("2024-01-01"), None] == (0, 0.0, 9.0)
    assert monthly[day("2024-03-01"), "Spin"] == (0, 5.5, 0.0)
    spend = {r[0]: r[1:] for r in tuples(K.risk_vs_spend(incidents, task_cost(tasks), demand))}
    assert spend["Lyft"] == (650, 2, 23.0, 3.0769, 35.3846)
    assert spend["Spin"] == (0, 1, 0.0, None, None)


def test_load_vs_handle(demand, rows):
    status = rows("vendor string, service_area_id int, event_time timestamp_ntz, handle_minutes int",
                  *[("Lyft", 1, at("2024-01-05 08:10:00"), m) for m in (10, 20, None)],
                  ("Lyft", 1, at("2024-01-05 09:10:00"), 60))
    assert tuples(K.load_vs_handle(status, demand)) == [("Lyft", 1, 4, 450.0, 30.0)]


def test_fleet_measures(incidents, rows):
    vehicles = rows("vehicle_id string, vendor string, battery_wh int, odometer_km int, status string",
                    ("a", "Lyft", 460, 4000, "active"), ("b", "Lyft", 460, 1000, "active"), ("c", "Lime", 520, 0, "active"))
    assert sorted(tuples(K.incidents_per_10k_km(incidents, vehicles))) == [
        ("Lime", 520, 1, 0, 0, None), ("Lyft", 460, 2, 5000, 2, 4.0),
    ]
    status = rows("vehicle_id string, event_time timestamp_ntz, handle_minutes int", ("b", at("2024-01-01 00:00:00"), 5),
                  ("a", at("2024-01-01 00:00:00"), None))
    assert sorted(tuples(K.vehicle_drill_through(vehicles, incidents, status))) == [
        ("a", "Lyft", "active", 2, 1, 0, at("2024-01-06 08:30:00")),
        ("b", "Lyft", "active", 0, 1, 5, at("2024-01-01 00:00:00")),
        ("c", "Lime", "active", 0, 0, 0, None),
    ]
    assert sorted(tuples(K.odometer_distribution(vehicles))) == [("Lime", 0, 1), ("Lyft", 1000, 1), ("Lyft", 4000, 1)]
    assert ("Lyft", "active", 460, 2, 1.0) in tuples(K.fleet_mix(vehicles))


def test_incident_without_resolution_still_counts(rows):
    t = at("2024-01-01 00:00:00")
    df = rows("incident_type string, vendor string, occurred_at timestamp_ntz, resolved_at timestamp_ntz, cost_usd double",
              ("crash", "Lyft", t, at("2024-01-01 00:10:00"), 1.0), ("crash", "Lyft", t, at("2024-01-01 00:20:00"), 2.0),
              ("crash", "Lyft", t, None, 4.0), ("theft", "Lyft", t, None, 8.0))
    assert sorted(tuples(K.incident_summary(df))) == [
        ("crash", "Lyft", 3, 15.0, 19.0, 7.0), ("theft", "Lyft", 1, None, None, 8.0),
    ]
