import pytest
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.operators import calibration as CA
from kickstand.operators import trips as TR
from tests.conftest import at, day, tuples

DEMAND = "day date, hour int, service_area_id int, vendor string, trips bigint"
AREAS = "service_area_id int, community_area_name string, area_type string"


@pytest.fixture(scope="module")
def areas(rows):
    return CA.area_catalog(None, rows(AREAS, (1, "Loop", "downtown"), (2, "Campus", "campus"), (3, "Docks", None)))


@pytest.fixture(scope="module")
def demand(rows):
    return rows(
        DEMAND,
        (day("2024-01-05"), 8, 1, "Lyft", 6),  # Friday
        (day("2024-01-06"), 8, 1, "Lime", 2),  # Saturday
        (day("2024-01-06"), 20, 2, "Lyft", 4),
        (day("2024-03-04"), 9, 1, "Lyft", 12),  # Monday
    )


def empty(demand):
    return demand.limit(0)


def test_hour_shape_gives_empty_hours_a_weight(demand):
    shape = {h: (n, w) for h, n, w in tuples(CA.hour_shape(demand))}
    whole = 1 + 21 / 24  # three hours hold all trips, the other 21 weigh 1/24 each
    assert shape[8] == (8, pytest.approx(8 / 24 / whole))
    assert shape[0] == (0, pytest.approx(1 / 24 / whole))
    assert sum(w for _, w in shape.values()) == pytest.approx(1)
    assert [w for _, _, w in tuples(CA.hour_shape(empty(demand)))] == pytest.approx([1 / 24] * 24)


def test_area_weights_are_smoothed(demand, areas):
    got = {a: (n, w) for a, n, w in tuples(CA.area_weights(demand, areas))}
    assert got == {
        1: (20, pytest.approx(20.5 / 25.5)), 2: (4, pytest.approx(4.5 / 25.5)), 3: (0, pytest.approx(0.5 / 25.5)),
    }


def test_vendor_area_mix_lists_every_vendor(demand, areas):
    got = {(v, a): w for a, v, _, w in tuples(CA.vendor_area_mix(demand, areas))}
    assert len(got) == 12
    assert got["Lyft", 1] == pytest.approx(18.5 / 23.5)
    assert got["Coco", 3] == pytest.approx(1 / 3)


def test_month_mix_respects_floors(demand):
    got = {(m, v): (raw, s) for m, v, raw, s in tuples(CA.vendor_month_mix(demand))}
    assert len(got) == 8
    january = day("2024-01-01")
    assert got[january, "Lime"] == (pytest.approx(2 / 12), pytest.approx(0.25 + 0.30 * 2 / 12))
    assert got[january, "Coco"] == (0.0, pytest.approx(0.07))
    assert sum(s for (m, _), (_, s) in got.items() if m == january) == pytest.approx(1)


def test_daily_median(demand):
    assert tuples(CA.daily_median(demand)) == [(6.0,)]
    assert tuples(CA.daily_median(empty(demand))) == [(50000.0,)]


def test_month_multiplier(demand):
    got = dict(tuples(CA.month_multiplier(demand)))
    assert got == {m: {1: 1.0, 3: 1.0}.get(m, 0.0) for m in range(1, 13)}
    assert dict(tuples(CA.month_multiplier(empty(demand)))) == C.DEFAULT_MONTH_MULTIPLIER


def test_weekend_boost(demand):
    # Saturday 6, Sunday missing (1); Monday 12, Friday 6, three missing weekdays (1 each)
    assert tuples(CA.weekend_boost(demand)) == [(pytest.approx((6 + 1) / 2 / ((12 + 6 + 3) / 5)),)]
    assert tuples(CA.weekend_boost(empty(demand))) == [(1.08,)]


def test_fleet_sizing(demand, rows):
    averages = dict(tuples(CA.vendor_daily_avg(demand)))
    assert averages == {"Lyft": pytest.approx(22 / 3), "Lime": 2.0, "Spin": 0.0, "Coco": 0.0}
    sized = CA.fleet_sizing(rows("vendor string, daily_avg double", ("Lyft", 750.1), ("Coco", 1.0), ("Spin", 0.0), ("x", 700.0)))
    assert tuples(sized, "vendor", "fleet_size", "last_vehicle_id") == [
        ("Lyft", 101, "LY00101"), ("Coco", 60, "CO00060"), ("Spin", 0, "SP00000"), ("x", 100, "X00100"),
    ]


def test_avg_trip_km(rows):
    trips = rows("distance_m int, km double", (1000, 1.5), (3000, None), (None, 2.5))
    assert tuples(CA.avg_trip_km(trips)) == [(2.0,)]
    assert tuples(CA.avg_trip_km(trips, km_col="km")) == [(2.0,)]
    assert tuples(CA.avg_trip_km(trips.limit(0))) == [(1.9,)]
    assert tuples(CA.avg_trip_km(trips, m_col=None)) == [(1.9,)]


def test_expected_demand_covers_the_calendar(demand, areas):
    spine = CA.expected_demand(demand, areas)
    days = 60  # 5 January to 4 March 2024
    assert spine.count() == days * 24 * 3 * 4
    total = spine.groupBy("day").agg(F.sum("expected_trips").alias("n"))
    assert {round(n, 6) for _, n in tuples(total)} == {5000.0}
    # over the areas an hour's total is the day's total times the hour's weight
    shape = {h: w for h, _, w in tuples(CA.hour_shape(demand))}
    hour = spine.filter((F.col("day") == "2024-02-10") & (F.col("hour") == 8)).agg(F.sum("expected_trips"))
    assert tuples(hour) == [(pytest.approx(5000 * shape[8]),)]
    # a month without trips falls back to the floors as its mix
    cell = {v: n for v, n in tuples(
        spine.filter((F.col("day") == "2024-02-10") & (F.col("hour") == 8) & (F.col("service_area_id") == 2)),
        "vendor", "expected_trips")}
    raw = {"Lyft": 0.28 * 1.05, "Lime": 0.25 * 1.02, "Spin": 0.10 * 0.95, "Coco": 0.07 * 0.92 * 1.25}
    for vendor, weight in raw.items():
        share = C.VENDOR_SHARE_FLOORS[vendor] + 0.30 * weight / sum(raw.values())
        assert cell[vendor] == pytest.approx(5000 * shape[8] * 4.5 / 25.5 * share)


def test_expected_demand_day_total(demand, areas):
    spine = CA.expected_demand(demand, areas, floor_total=1, scale=10.0)
    totals = dict(tuples(spine.groupBy("day").agg(F.round(F.sum("expected_trips"), 6))))
    assert totals[day("2024-01-05")] == 60.0  # median 6 * month 1.0 * scale
    assert totals[day("2024-01-06")] == 50.0  # 60 * weekend boost 0.8333, rounded down
    assert totals[day("2024-02-10")] == 1.0  # a month without trips has level 0


def test_demand_vs_expected_matches_the_spine(demand, areas):
    rows_ = CA.demand_vs_expected(demand, demand, areas, floor_total=1)
    keys = ["day", "hour", "service_area_id", "vendor"]
    spine = CA.expected_demand(demand, areas, floor_total=1).withColumnRenamed("expected_trips", "spine")
    joined = tuples(rows_.join(spine, keys), "trips", "expected_trips", "spine", "observed_ratio")
    assert len(joined) == 4
    for trips, expected, from_spine, ratio in joined:
        assert expected == pytest.approx(from_spine)
        assert ratio == pytest.approx(trips / expected)


def test_empty_demand_gives_empty_spine(demand, areas):
    assert CA.expected_demand(empty(demand), areas).count() == 0


def test_demand_rows_and_table_agree(rows, areas):
    trips = rows("vendor string, started_at timestamp_ntz, service_area_id int", ("lyft", at("2024-01-05 08:00:00"), 1),
                 ("Lyft", at("2024-01-05 08:59:59"), 1), (None, at("2024-01-06 00:00:00"), 2), ("Lyft", None, 1))
    table = TR.trips_hourly(trips)
    assert sorted(tuples(table)) == [
        (day("2024-01-05"), 8, 1, "Lyft", 2), (day("2024-01-06"), 0, 2, "Coco", 1),
    ]
    for measure in (CA.hour_shape, CA.daily_median, CA.month_multiplier, CA.weekend_boost, CA.vendor_month_mix):
        assert sorted(tuples(measure(table))) == sorted(tuples(measure(TR.demand_rows(trips))))


def test_a_vendor_outside_the_canonical_names_keeps_its_trips(rows):
    demand = rows("day date, hour int, service_area_id int, vendor string, trips bigint",
                  (day("2024-01-05"), 8, 1, "Bolt", 100), (day("2024-01-05"), 8, 1, None, 50))
    areas = rows("service_area_id int, community_area_name string, area_type string", (1, "A", "campus"))
    average = dict(tuples(CA.vendor_daily_avg(demand), "vendor", "daily_avg"))
    assert average == {"Bolt": 100.0, **dict.fromkeys(C.VENDORS, 0.0)}
    mix = {r["vendor"]: r for r in CA.vendor_month_mix(demand).collect()}
    assert mix["Bolt"]["raw"] == pytest.approx(2 / 3) and mix["Bolt"]["share"] == pytest.approx(0.3) and len(mix) == len(C.VENDORS) + 1
    weights = {r["vendor"]: r["trips"] for r in CA.vendor_area_mix(demand, areas).collect()}
    assert weights == {"Bolt": 100, **dict.fromkeys(C.VENDORS, 0)}
    named = [*C.VENDORS, "Bolt"]
    assert {r["vendor"] for r in CA.expected_demand(demand, areas, vendors=named).collect()} == set(named)
    compared = CA.demand_vs_expected(demand.filter("vendor is not null"), demand, areas, vendors=named).first()
    assert compared["expected_trips"] > 0
