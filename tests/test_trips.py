import pytest

from kickstand.operators import calibration as CA
from kickstand.operators import trips as TR
from kickstand.sources import readers as R
from tests.conftest import at, day, tuples

TRIPS = "vendor string, started_at timestamp_ntz, duration_s int, distance_m int"
T0 = at("2024-05-01 08:00:00")


@pytest.mark.parametrize(
    "seconds,metres,slow,fast",
    [
        (3600, 3000, True, False),  # exactly 3 km/h
        (3600, 5000, True, True),  # exactly 5 km/h
        (1200, 10000, True, True),  # exactly 30 km/h
        (600, 5833, True, False),  # just under 35 km/h
        (3600, 20000, True, True),  # exactly 20 km
        (3600, 20001, False, False),
        (60, 400, False, False),  # exactly 60 s
        (61, 400, True, True),
        (0, 400, False, False),
        (None, 400, False, False),
        (600, 0, False, False),
        (600, None, False, False),
    ],
)
def test_quality_limits(rows, seconds, metres, slow, fast):
    df = rows(TRIPS, ("Lyft", T0, seconds, metres))
    assert (TR.quality(df, 3, 35).count() == 1, TR.quality(df, 5, 30).count() == 1) == (slow, fast)


def good(vendor, time):
    return (vendor, time, 600, 2000)


def test_null_keys(rows):
    df = rows(TRIPS, good("Lyft", T0), good("Lyft", T0), good(None, T0), good("Lime", None), good(None, None))
    daily = tuples(TR.daily_trips_by_vendor(df))
    assert daily == [(day("2024-05-01"), "Lyft", 2, 2, 1.0)]
    average = tuples(TR.avg_trips_by_vendor(df), "vendor", "day", "trips")
    assert average == [("Lyft", day("2024-05-01"), 2), (None, day("2024-05-01"), 1), ("Lime", None, 1), (None, None, 1)]
    # the trip without a vendor counts in the day total, but has no row of its own
    hourly = tuples(TR.hourly_demand_by_vendor(df))
    assert hourly == [(day("2024-05-01"), "Lyft", 8, 2, 2, 3, 1.0, 0.6667)]


def test_date_range_is_half_open(rows):
    df = rows(TRIPS, *[good("Lyft", at(f"2024-05-0{d} 00:00:00")) for d in (1, 2, 3)])
    got = TR.daily_trips_by_vendor(df, start="2024-05-01", end="2024-05-03")
    assert [r[0] for r in tuples(got)] == [day("2024-05-01"), day("2024-05-02")]


def test_averages_and_percentiles(rows):
    df = rows(TRIPS, *[("Spin", T0, s, m) for s, m in [(300, 1000), (600, 2000), (900, 4000), (905, 4005)]])
    (got,) = tuples(TR.avg_trips_by_vendor(df))
    assert got == ("Spin", day("2024-05-01"), 4, 11.27, 2.75, 3.0, 4.0035)


def test_shares_sum_to_one(rows):
    df = rows(TRIPS, *[good(v, at(f"2024-05-01 {h:02d}:30:00")) for h in range(7, 12) for v in ("Lyft", "Lime", "Coco")])
    hourly = tuples(TR.hourly_demand_by_vendor(df), "vendor", "share_within_vendor_day", "share_within_day")
    assert sum(r[2] for r in hourly) == pytest.approx(1, abs=0.001)
    for vendor in ("Lyft", "Lime", "Coco"):
        assert sum(r[1] for r in hourly if r[0] == vendor) == pytest.approx(1)


def test_demand_shares(rows):
    hourly = rows("day date, hour int, service_area_id int, vendor string, trips bigint",
                  (day("2024-01-01"), 8, 1, "Lyft", 3), (day("2024-01-01"), 8, 2, "Lime", 1),
                  (day("2024-01-01"), 9, 1, "Lyft", 1))
    got = sorted(tuples(TR.demand_shares(hourly), "hour", "vendor", "dayhour_total", "share_within_day_hour",
                        "vendor_day_total", "share_within_vendor_day"))
    assert got == [(8, "Lime", 4, 0.25, 1, 1.0), (8, "Lyft", 4, 0.75, 4, 0.75), (9, "Lyft", 1, 1.0, 4, 0.25)]


def test_area_join_never_multiplies(rows):
    demand = rows("service_area_id int, trips bigint", (1, 5), (9, 2))
    areas = rows("service_area_id int, community_area_name string, area_type string", (1, "Loop", "downtown"),
                 (1, "Loop", "downtown"))
    got = sorted(tuples(TR.with_area_type(demand, areas), "service_area_id", "trips", "area_type"))
    assert got == [(1, 5, "downtown"), (9, 2, None)]


# --- raw trips --------------------------------------------------------------------


def test_detect_exact_before_substring_in_file_order():
    found = R.detect_columns(["my_vendor_name", "Vendor", "Trip Start Time", "Start Community Area Name", "km"])
    assert found["vendor"] == "Vendor"
    assert found["start_time"] == "Trip Start Time"
    assert found["start_area_name"] == "Start Community Area Name"
    assert (found["end_area_name"], found["distance_km"], found["distance_m"]) == (None, "km", None)
    assert R.detect_columns(["provider_x", "operator"])["vendor"] == "operator"


def test_missing_required_columns(rows):
    with pytest.raises(R.MissingColumns):
        R.trips_canon(rows("vendor string", ("Lyft",)))


def test_raw_csv_to_canonical_demand(spark, tmp_path):
    (tmp_path / "trips.csv").write_text(
        "Trip ID,Start Time,Vendor,Start Community Area Name,End Community Area Name,Trip Distance,unused\n"
        "1,2024-05-01 08:15:00,lyft,,LOOP,1500,x\n"
        '2,05/01/2024 08:20:00 AM,LYFT, Loop ,Hyde Park,2500,"a,b"\n'
        "3,not a time,lime,Loop,Loop,10,x\n"
        "4,2024-05-02 09:00:00,Bird,Hyde Park,,n/a,x\n"
        "5,2024-05-03 09:00:00,spin,,,700,x\n"
    )
    canon = R.read_raw_trips(spark, str(tmp_path / "trips.csv"))
    assert sorted(tuples(canon, "vendor", "day", "hour", "area_name", "distance_m"), key=str) == sorted(
        [
            ("Lyft", day("2024-05-01"), 8, "LOOP", 1500),
            ("Lyft", day("2024-05-01"), 8, "Loop", 2500),
            ("Coco", day("2024-05-02"), 9, "Hyde Park", None),
            ("Spin", day("2024-05-03"), 9, None, 700),
        ],
        key=str,
    )
    areas = spark.createDataFrame([(7, "Loop", "downtown"), (8, "Hyde Park", "campus")],
                                  "service_area_id int, community_area_name string, area_type string")
    hourly = TR.canon_hourly(canon, CA.area_catalog(canon, areas))
    assert sorted(tuples(hourly), key=str) == sorted(
        [
            (day("2024-05-01"), 8, 7, "Loop", "Lyft", 2),
            (day("2024-05-02"), 9, 8, "Hyde Park", "Coco", 1),
            (day("2024-05-03"), 9, None, None, "Spin", 1),
        ],
        key=str,
    )
    window = R.read_raw_trips(spark, str(tmp_path / "trips.csv"), start="2024-05-02", end="2024-05-02")
    assert tuples(window, "vendor") == [("Coco",)]


def test_numbered_areas(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "started_at,provider,start_area_id,distance_km\n"
        "2024-05-01 08:15:00,lyft,8,1.25\n2024-05-01 08:16:00,lyft,32.0,2\n2024-05-01 09:16:00,lime,x,\n"
    )
    canon = R.read_raw_trips(spark, str(tmp_path / "t.csv"))
    assert tuples(canon, "area_name", "area_num", "distance_m") == [(None, 8, 1250), (None, 32, 2000), (None, None, None)]
    catalog = CA.area_catalog(canon)
    assert sorted(tuples(catalog, "service_area_id", "community_area_name", "area_key")) == [
        (8, "CA 08", "ca 08"), (32, "CA 32", "ca 32"),
    ]
    assert sorted(r[0] or 0 for r in tuples(TR.canon_hourly(canon, catalog), "service_area_id")) == [0, 8, 32]


def test_area_catalog_from_names(rows):
    canon = rows("area_name string, area_num int", ("Loop", None), ("Austin", None), ("Loop", None), (None, None))
    assert sorted(tuples(CA.area_catalog(canon))) == [
        (1, "Austin", "residential", "austin", "Austin, Chicago, IL, USA"),
        (2, "Loop", "residential", "loop", "Loop, Chicago, IL, USA"),
    ]


def test_files_with_other_column_orders_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Start Time,Vendor,Trip Distance\n2024-05-01 08:15:00,lyft,1500\n")
    (tmp_path / "b.csv").write_text("Vendor,Start Time,extra\nspin,7/1/2024 8:05,1\nlime,not a time,2\n")
    canon = R.read_raw_trips(spark, f"{tmp_path}/*.csv")
    assert sorted(tuples(canon, "vendor", "started_at", "distance_m"), key=str) == [
        ("Lyft", at("2024-05-01 08:15:00"), 1500), ("Spin", at("2024-07-01 08:05:00"), None)]
    rejected = R.rejected_trips(R.read_text_csv(spark, f"{tmp_path}/*.csv"))
    assert tuples(rejected, "Vendor") == [("lime",)]
    assert R.csv_files(spark, str(tmp_path)) == R.csv_files(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])


def test_headers_that_read_alike_are_ambiguous():
    with pytest.raises(ValueError, match="ambiguous headers for vendor"):
        R.detect_columns(["Vendor", "vendor_", "Start Time"])
