import datetime as dt
import random

import pytest

from kickstand.operators import maintenance as M
from tests.conftest import at, day, tuples

EVENTS = "vehicle_id string, event_id bigint, event_time timestamp_ntz, event_type string"
OUT, IN = "maintenance_pickup", "maintenance_dropoff"


def events(rows, *data):
    return rows(EVENTS, *[(v, i, at(t), k) for i, (v, t, k) in enumerate(data)])


def test_only_adjacent_pickup_dropoff_pairs(rows):
    df = events(
        rows,
        ("a", "2024-01-01 08:00:00", OUT),
        ("a", "2024-01-01 09:00:00", OUT),
        ("a", "2024-01-01 11:30:00", IN),
        ("a", "2024-01-01 12:00:00", IN),
        ("a", "2024-01-01 13:00:00", OUT),  # never brought back
        ("b", "2024-01-01 08:00:00", OUT),  # no time passes
        ("b", "2024-01-01 08:00:00", IN),
        ("c", "2024-01-01 08:00:00", "offline"),
    )
    assert tuples(M.avg_downtime_per_vehicle(df)) == [(day("2024-01-01"), 1, 2.5, 2.5, 2.5)]


def test_pairs_across_idle_days(rows):
    df = events(
        rows,
        ("a", "2024-01-01 23:00:00", OUT),
        ("a", "2024-01-09 01:00:00", IN),
        ("a", "2024-01-09 02:00:00", OUT),
        ("a", "2024-02-01 02:00:00", "offline"),
        ("a", "2024-03-01 02:00:00", IN),
    )
    assert sorted(tuples(M.downtime_pairs(df), "pickup_time", "dropoff_time")) == [
        (at("2024-01-01 23:00:00"), at("2024-01-09 01:00:00")),
        (at("2024-01-09 02:00:00"), at("2024-03-01 02:00:00")),
    ]


def test_ties_follow_event_id(rows):
    df = rows(EVENTS, ("a", 2, at("2024-01-01 08:00:00"), OUT), ("a", 1, at("2024-01-01 08:00:00"), IN),
              ("a", 3, at("2024-01-01 09:00:00"), IN))
    assert tuples(M.downtime_pairs(df), "downtime_us") == [(3_600_000_000,)]


def test_one_hot_vehicle_against_brute_force(rows):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(4000):
        vehicle = rng.choice([None, "v1", "v2", "hot", "hot", "hot"])
        data.append((vehicle, i, start + dt.timedelta(seconds=rng.randrange(40 * 86400)), rng.choice([OUT, IN])))
    want = []
    for vehicle in {d[0] for d in data}:
        own = sorted((t, i, k) for v, i, t, k in data if v == vehicle)
        want += [(vehicle, a[0], b[0]) for a, b in zip(own, own[1:]) if a[2] == OUT and b[2] == IN and b[0] > a[0]]
    got = tuples(M.downtime_pairs(rows(EVENTS, *data)), "vehicle_id", "pickup_time", "dropoff_time")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_other_event_names(rows):
    df = rows("vehicle_id string, id bigint, occurred_at timestamp_ntz, event_type string",
              ("a", 1, at("2024-01-01 08:00:00"), "offline"), ("a", 2, at("2024-01-01 10:00:00"), "retrieval"))
    got = M.avg_downtime_per_vehicle(df, out_type="offline", in_type="retrieval", time_col="occurred_at", tiebreak="id")
    assert tuples(got, "avg_downtime_h") == [(2.0,)]


def test_service_events(rows):
    df = events(rows, ("a", "2024-01-01 08:00:00", OUT), ("a", "2024-01-01 09:00:00", OUT),
                ("b", "2024-01-01 09:00:00", OUT), ("b", "2024-01-02 09:00:00", OUT), ("c", "2024-01-02 09:00:00", IN))
    assert tuples(M.service_events_per_day(df)) == [(day("2024-01-01"), 3, 2), (day("2024-01-02"), 1, 1)]


def test_weekly_share_of_fleet(rows):
    df = events(rows, ("a", "2023-12-31 23:59:59", OUT), ("a", "2024-01-01 00:00:00", OUT),
                ("a", "2024-01-07 23:59:59", OUT), ("b", "2024-01-03 00:00:00", OUT), ("z", "2024-01-03 00:00:00", IN))
    fleet = rows("vehicle_id string", ("a",), ("b",), ("c",), ("c",), (None,))
    assert tuples(M.weekly_fleet_maintenance_percent(df, fleet)) == [
        (day("2023-12-25"), 1, 3, pytest.approx(33.33)), (day("2024-01-01"), 2, 3, pytest.approx(66.67)),
    ]
    nobody = rows("vehicle_id string")
    assert tuples(M.weekly_fleet_maintenance_percent(df, nobody), "pct_fleet_maintenance") == [(None,), (None,)]
