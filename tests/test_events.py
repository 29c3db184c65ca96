"""Incidents, status events, tasks and vehicles."""

import pytest
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.operators import fleet as FL
from kickstand.operators import incidents as I
from kickstand.operators import status as ST
from kickstand.operators import tasks as TK
from tests.conftest import at, day, tuples

TYPED = "day date, hour int, service_area_id int, vendor string, trips bigint, area_type string"


def test_incident_features(rows):
    df = rows("incident_type string, occurred_at timestamp_ntz, resolved_at timestamp_ntz",
              ("crash", at("2024-01-07 23:10:00"), at("2024-01-08 00:09:59")), ("theft", at("2024-01-07 23:10:00"), None))
    got = tuples(I.incident_features(df), "trip_related", "resolve_minutes", "hour_band", "weekday")
    assert got == [(True, 59, "night", 6), (False, None, "night", 6)]


def test_type_mix_and_expected_incidents(rows):
    df = rows(TYPED, (day("2024-07-01"), 17, 1, "Spin", 1000, "downtown"), (day("2024-01-01"), 3, 2, "odd", 10, None))
    mix = tuples(I.expected_incidents(df), "vendor", "incident_type", "probability", "expected_incidents")
    assert len(mix) == 12
    spin = {t: p for v, t, p, _ in mix if v == "Spin"}
    raw = {t: C.INCIDENT_RATE_PER_1K[t] * C.INCIDENT_BAND_MULT[t]["evening"] * C.INCIDENT_AREA_MULT[t]["downtown"]
           * C.INCIDENT_MONTH_MULT[t][6] for t in C.INCIDENT_RATE_PER_1K}
    assert spin == {t: pytest.approx(w / sum(raw.values())) for t, w in raw.items()}  # the vendor factor cancels
    assert sum(e for v, _, _, e in mix if v == "Spin") == pytest.approx(1.46)
    assert sum(p for v, _, p, _ in mix if v == "odd") == pytest.approx(1)


def test_incidents_vs_expected_keeps_both_sides(rows):
    demand = rows(TYPED, (day("2024-01-01"), 3, 2, "Lyft", 1000, "campus"))
    incidents = rows("vendor string, occurred_at timestamp_ntz, incident_type string",
                     ("Lyft", at("2024-01-09 00:00:00"), "crash"), ("Lime", at("2024-02-09 00:00:00"), "crash"))
    got = {(v, m, t): (n, r) for v, m, t, n, _, r in tuples(I.incidents_vs_expected(incidents, demand))}
    assert len(got) == 7
    assert got["Lime", day("2024-02-01"), "crash"] == (1, None)
    assert got["Lyft", day("2024-01-01"), "crash"][0] == 1 and got["Lyft", day("2024-01-01"), "theft"] == (0, 0.0)


def test_status_sla(rows):
    df = rows("event_type string, handle_minutes int, event_time timestamp_ntz",
              *[(k, m, at("2024-01-01 00:00:00")) for k, m in [
                  ("battery_low", 119), ("battery_low", 120), ("battery_low", 121), ("offline", 60), ("maintenance", 481),
                  ("rebalance", None), ("deployment", 10)]])
    assert tuples(ST.status_sla(df), "sla_minutes", "sla_met_int") == [
        (120, 1), (120, 1), (120, 0), (60, 1), (480, 0), (180, None), (None, None),
    ]
    assert tuples(ST.status_sla(df), "handled_at")[2] == (at("2024-01-01 02:01:00"),)


def test_status_flags(rows):
    df = rows("event_type string, event_subtype string, handle_minutes int", ("rebalance", "clear_footpath", 5),
              ("rebalance", "event_coverage", 5), ("rebalance", None, 5), ("offline", None, 7), ("maintenance", None, 8),
              ("retrieval", "sweep", None))
    assert tuples(ST.status_flags(df), "offline_minutes", "compliance_flag") == [
        (None, True), (None, False), (None, False), (7, False), (8, False), (None, True),
    ]


def test_active_vehicles(rows):
    demand = rows(TYPED, (day("2024-01-01"), 8, 1, "Lyft", 100, "campus"), (day("2024-01-01"), 8, 2, "Lyft", 100, "campus"),
                  (day("2024-01-01"), 8, 3, "Lyft", 10, "campus"))
    vehicles = rows("vendor string, service_area_id_home int", ("Lyft", 1), ("Lyft", 1))
    assert sorted(tuples(ST.with_active(demand, vehicles), "service_area_id", "active_vehicles")) == [(1, 2), (2, 5), (3, 3)]
    assert sorted(tuples(ST.with_active(demand), "service_area_id", "active_vehicles")) == [(1, 5), (2, 5), (3, 3)]


@pytest.mark.parametrize("hour,deployed,retrieved", [(5, 0, 0), (6, 0.045, 0), (10, 0.036, 0), (11, 0, 0), (20, 0, 0),
                                                     (21, 0, 0.06), (1, 0, 0.06), (2, 0, 0)])
def test_sweep_hours(rows, hour, deployed, retrieved):
    df = rows(TYPED, (day("2024-01-01"), hour, 1, "Lyft", 10, "campus"))
    got = dict(tuples(ST.expected_status_events(df), "event_type", "expected"))
    assert (got["deployment"], got["retrieval"]) == (pytest.approx(deployed), pytest.approx(retrieved))


def test_expected_rates(rows):
    df = rows(TYPED, (day("2024-01-01"), 8, 1, "Coco", 1000, "Downtown"), (day("2024-01-01"), 8, 1, "odd", 1000, None))
    status = tuples(ST.expected_status_events(df), "vendor", "event_type", "expected")
    assert ("Coco", "rebalance", pytest.approx(1.3 * 1.25 * 1.25 * 1.08)) in status
    assert ("Coco", "offline", pytest.approx(50 * 0.0022 * 1.0 * 1.1 * 1.08)) in status
    assert ("odd", "rebalance", pytest.approx(1.3 * 1.25)) in status
    tasks = tuples(TK.expected_tasks(df), "vendor", "task_type", "expected")
    assert ("Coco", "repair", pytest.approx(0.35 * 1.0 * 1.1 * 1.08)) in tasks
    fleet = ST.expected_fleet_rate(ST.with_active(df), C.STATUS_RATE_PER_VEHICLE_HOUR, C.STATUS_BAND_MULT, C.STATUS_AREA_MULT)
    assert fleet.count() == 4


def test_workload_uses_the_time_of_the_event(rows):
    demand = rows("day date, hour int, service_area_id int, vendor string, trips bigint",
                  (day("2024-01-02"), 0, 1, "Lyft", 7), (day("2024-01-01"), 23, 1, "Lyft", 9))
    tasks = rows("id int, created_at timestamp_ntz, service_area_id int, vendor string",
                 (1, at("2024-01-02 00:10:00"), 1, "Lyft"), (2, at("2024-01-01 23:10:00"), 1, "Lyft"),
                 (3, at("2024-01-01 23:10:00"), 1, "Lime"), (4, at("2024-01-01 23:10:00"), 1, None), (5, None, 1, "Lyft"))
    assert sorted(tuples(TK.with_workload(tasks, demand, "created_at"), "id", "workload_trips_hour")) == [
        (1, 7), (2, 9), (3, 0), (4, 0), (5, 0),
    ]


def test_task_candidates(rows):
    incidents = rows("incident_id bigint, incident_type string, vendor string, service_area_id int, occurred_at timestamp_ntz",
                     *[(i, k, "Lyft", 1, at("2024-01-01 00:00:00")) for i, k in enumerate(
                         ["illegal_parking", "crash", "vandalism", "theft", "complaint", "battery_failure"])],
                     (9, "crash", "Lyft", 1, None))
    status = rows("event_id bigint, event_type string, vendor string, service_area_id int, event_time timestamp_ntz",
                  *[(i, k, "Lyft", 1, at("2024-01-01 00:00:00")) for i, k in enumerate(
                      ["battery_low", "rebalance", "offline", "maintenance"])])
    got = tuples(TK.task_candidates(incidents, status), "task_type", "linked_incident_id", "linked_event_id", "source")
    assert sorted(got, key=str) == sorted(
        [("pickup_illegal_parking", 0, None, "incident_link"), ("repair", 1, None, "incident_link"),
         ("repair", 2, None, "incident_link"), ("battery_swap", None, 0, "incident_link"),
         ("rebalance", None, 1, "incident_link")], key=str)
    assert TK.task_candidates(incidents).count() == 3 and TK.task_candidates(status=status).count() == 2


TASKS = "task_id bigint, task_type string, status string, created_at timestamp_ntz, response_minutes int, work_minutes int"


def test_task_timeline_and_sla_by_status(rows):
    df = rows(TASKS + ", wait int", *[(i, "repair", s, at("2024-01-01 23:00:00"), 30, 45, 10) for i, s in enumerate(
        ["done", "open", "assigned", "canceled"])])
    cols = ["assigned_at", "completed_at", "response_minutes", "work_minutes", "total_minutes"]
    start, end = at("2024-01-01 23:30:00"), at("2024-01-02 00:15:00")
    assert tuples(TK.task_timeline(df), *cols) == [
        (start, end, 30, 45, 75), (None, None, None, None, None), (start, None, 30, None, None), (start, None, 30, None, None),
    ]
    assert tuples(TK.task_timeline(df, "wait"), "completed_at") == [
        (end,), (None,), (None,), (at("2024-01-01 23:40:00"),),
    ]
    assert {r[0] for r in tuples(TK.task_timeline(df), "deadline_at")} == {at("2024-01-02 23:00:00")}
    late = rows(TASKS, *[(i, k, s, at("2024-01-01 23:00:00"), 40, 50, ) for i, (k, s) in enumerate(
        [("pickup_illegal_parking", "done"), ("repair", "open"), ("odd", "done")])], (3, "pickup_illegal_parking", "done",
        at("2024-01-01 23:00:00"), 41, 50))
    assert tuples(TK.task_sla(late), "sla_target_min", "sla_met_int") == [(90, 1), (1440, None), (None, None), (90, 0)]


def test_priority_and_cost(rows):
    df = rows(TASKS + ", move_km double", *[(i, k, "done", at(f"2024-01-01 {h}:00:00"), 1, 1, 2.0) for i, (k, h) in enumerate(
        [("repair", "15"), ("repair", "16"), ("repair", "23"), ("pickup_illegal_parking", "10"), ("battery_swap", "20"),
         ("rebalance", "20"), ("odd", "20")])])
    assert [r[0] for r in tuples(TK.task_priority(df), "priority")] == [2, 1, 1, 1, 2, 2, 2]
    assert [r[0] for r in tuples(TK.task_cost(df), "cost_usd")] == [9.0, 9.0, 9.0, 9.0, 7.6, 6.2, 3.0]


def test_linkage_splits_into_linked_and_unlinked(rows):
    tasks = rows("task_id bigint, linked_incident_id bigint, linked_event_id bigint, created_at timestamp_ntz",
                 (1, 10, None, at("2024-01-01 01:00:00")), (2, 10, None, at("2024-01-01 02:00:00")),
                 (3, 99, None, at("2024-01-01 02:00:00")), (4, None, 7, at("2024-01-01 02:00:00")),
                 *[(i, None, None, at("2024-01-01 02:00:00")) for i in range(5, 60)])
    incidents = rows("incident_id bigint, incident_type string, occurred_at timestamp_ntz",
                     (10, "crash", at("2024-01-01 00:30:30")), (0, "theft", at("2024-01-01 00:00:00")))
    status = rows("event_id bigint, event_type string, event_time timestamp_ntz", (7, "rebalance", at("2024-01-01 01:45:00")))
    got = sorted(tuples(TK.task_linkage(tasks, incidents, status), "task_id", "incident_type", "event_type", "minutes_to_task"))
    assert got[:4] == [(1, "crash", None, 29), (2, "crash", None, 89), (3, None, None, None), (4, None, "rebalance", 15)]
    assert len(got) == 59 and all(r[1:] == (None, None, None) for r in got[4:])
    linked, unlinked = TK.linked_tasks(tasks, incidents), TK.unlinked_tasks(tasks, incidents)
    assert sorted(r[0] for r in tuples(linked, "task_id")) == [1, 2]
    assert sorted(r[0] for r in tuples(unlinked, "task_id")) == list(range(3, 60))


@pytest.fixture
def mostly_keyless(spark, rows):
    """4,000 tasks, all but 40 without any cause, incidents and status events; joins shuffle into 8 partitions as planned."""
    made, before = at("2024-01-01 02:00:00"), at("2024-01-01 01:45:00")
    tasks = rows("task_id bigint, linked_incident_id bigint, linked_event_id bigint, created_at timestamp_ntz",
                 *[(i, i if i % 100 == 0 else None, i if i % 100 == 50 else None, made) for i in range(4000)])
    incidents = rows("incident_id bigint, incident_type string, occurred_at timestamp_ntz", *[(i, "crash", before) for i in range(100, 4000)])
    status = rows("event_id bigint, event_type string, event_time timestamp_ntz", *[(i, "rebalance", before) for i in range(4000)])
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield tasks, incidents, status
    for k, v in old.items():
        spark.conf.set(k, v)


def shares(df):
    """Rows of each partition that has any."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_linkage_deals_out_tasks_without_a_cause(mostly_keyless):
    tasks, incidents, status = mostly_keyless
    for linked in (TK.task_linkage(tasks, incidents), TK.task_linkage(tasks, incidents, status)):
        got = shares(linked)
        assert sum(got) == 4000 and len(got) == 8 and max(got) < 1000
    got = linked.groupBy("incident_type", "event_type", "minutes_to_task").count().collect()
    assert {tuple(r) for r in got} == {(None, None, None, 3921), ("crash", None, 15, 39), (None, "rebalance", 15, 40)}


def test_unlinked_tasks_deal_out_tasks_without_an_incident(mostly_keyless):
    tasks, incidents, _ = mostly_keyless
    got = shares(TK.unlinked_tasks(tasks, incidents))
    assert sum(got) == 3961 and len(got) == 8 and max(got) < 1000


def test_vehicle_features(rows):
    df = rows("vendor string, battery_wh int, odometer_km int, in_service_since date, decommissioned_at date",
              ("Lyft", 520, 380, day("2024-01-01"), None), ("Lyft", 520, 380, day("2024-01-01"), day("2024-01-05")),
              ("odd", 460, 19, day("2024-03-01"), None))
    got = tuples(FL.vehicle_features(df, "2024-01-21"), "days_in_service", "est_daily_energy_wh", "battery_cycles_est")
    assert got == [(20, 350, 13), (4, 1750, 13), (1, 330, 0)]


POLICIES = "vendor string, start_date date, end_date date, base_fare double, per_minute double, per_km double"


def test_trip_cost_uses_the_policy_in_force(rows):
    pricing = rows(POLICIES, ("Lyft", day("2024-01-01"), day("2024-02-14"), 1.0, 0.5, 0.25),
                   ("Lyft", day("2024-02-15"), day("2024-12-31"), 2.0, 0.5, 0.25),
                   ("Lime", day("2024-03-01"), day("2024-02-01"), 9.0, 9.0, 9.0))
    trips = rows("vendor string, started_at timestamp_ntz, duration_s int, distance_m int",
                 ("Lyft", at("2024-02-14 23:59:59"), 600, 2000), ("Lyft", at("2024-02-15 00:00:00"), 600, 2000),
                 ("Lyft", at("2025-01-01 00:00:00"), 600, 2000), ("Lime", at("2024-02-15 00:00:00"), 600, 2000))
    assert tuples(FL.trip_cost(trips, pricing).orderBy("started_at", "vendor"), "trip_cost") == [(6.5,), (None,), (7.5,), (None,)]
    assert sorted(tuples(FL.trip_cost_by_vendor_month(trips, pricing))) == [
        ("Lime", day("2024-02-01"), 0, 1, None), ("Lyft", day("2024-02-01"), 2, 0, 14.0), ("Lyft", day("2025-01-01"), 0, 1, None)]
    assert FL.overlapping_policies(pricing).count() == 0
    twice = pricing.unionByName(rows(POLICIES, ("Lyft", day("2024-06-01"), day("2024-06-02"), 0.0, 0.0, 0.0)))
    assert FL.overlapping_policies(twice).count() == 1
    with pytest.raises(Exception, match="overlapping pricing policies of Lyft"):
        FL.trip_cost(trips, twice).collect()


def test_policy_without_an_end_stays_in_force(rows):
    pricing = rows(POLICIES, ("Lyft", day("2024-01-01"), day("2024-01-31"), 1.0, 0.0, 0.0), ("Lyft", day("2024-02-01"), None, 2.0, 0.0, 0.0))
    trips = rows("vendor string, started_at timestamp_ntz, duration_s int, distance_m int",
                 ("Lyft", at("2024-01-31 10:00:00"), 60, 0), ("Lyft", at("2031-05-01 10:00:00"), 60, 0))
    assert sorted(tuples(FL.trip_cost(trips, pricing), "trip_cost")) == [(1.0,), (2.0,)]
    more = pricing.unionByName(rows(POLICIES, ("Lyft", day("2030-01-01"), None, 0.0, 0.0, 0.0)))
    assert FL.overlapping_policies(more).count() == 1
