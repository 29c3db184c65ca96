import pytest
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.functions import columns as X
from tests.conftest import at, day, tuples


def test_vendor_canon(rows):
    names = ["LYFT", " lime ", "Spin", "coco", "bird", "TIER", "Super-Pedestrian", "who?", "", None, "Lime"]
    df = rows("vendor string", *[(n,) for n in names])
    got = [r[0] for r in tuples(df.select(X.vendor_canon("vendor")))]
    assert got == ["Lyft", "Lime", "Spin", "Coco", "Coco", "Coco", "Spin", "Coco", "Coco", "Coco", "Lime"]


def test_vendor_canon_other_map(rows):
    df = rows("vendor string", ("Lyft",), ("x-1",))
    got = tuples(df.select(X.vendor_canon("vendor", {"x1": "Xone"}, "other")))
    assert got == [("other",), ("Xone",)]


def test_hour_bands(rows):
    hours = [0, 5, 6, 9, 10, 15, 16, 19, 20, 23]
    df = rows("hour int", *[(h,) for h in hours], (None,))
    got = [r[0] for r in tuples(df.select(X.hour_band("hour")))]
    assert got == [
        "late_night", "late_night", "morning", "morning", "midday", "midday", "evening", "evening", "night", "night", None,
    ]


def test_first_text_skips_blank_and_null(rows):
    df = rows("a string, b string", ("", "end"), (None, " end "), (None, None), (" start ", "end"), ("  ", ""))
    assert [r[0] for r in tuples(df.select(X.first_text("a", "b")))] == ["end", "end", None, "start", None]


def test_parse_time(rows):
    texts = ["2024-03-10 02:30:00", "2024-03-10T02:30:00", "03/10/2024 02:30:00 PM", "03/10/2024 02:30", "no", "", None]
    df = rows("s string", *[(t,) for t in texts])
    got = [r[0] for r in tuples(df.select(X.parse_time("s")))]
    assert got == [
        at("2024-03-10 02:30:00"), at("2024-03-10 02:30:00"), at("2024-03-10 14:30:00"), at("2024-03-10 02:30:00"),
        None, None, None,
    ]


def test_week_starts_monday_across_new_year(rows):
    df = rows("d date", (day("2023-12-31"),), (day("2024-01-01"),), (day("2025-01-01"),))
    assert [r[0] for r in tuples(df.select(X.week_start("d")))] == [
        day("2023-12-25"), day("2024-01-01"), day("2024-12-30"),
    ]


def test_micros_between_ignores_session_zone(spark, rows):
    df = rows("a timestamp_ntz, b timestamp_ntz", (at("2024-03-10 01:00:00"), at("2024-03-10 03:30:00.000007")),
              (at("2024-03-12 00:00:00"), at("2024-03-10 23:59:59.5")))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Chicago"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [r[0] for r in tuples(df.select(X.micros_between("a", "b")))] == [
                int(2.5 * 3_600_000_000) + 7, -86_400_500_000,
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_minutes_and_add_minutes(rows):
    df = rows("t timestamp_ntz, m int", (at("2024-01-31 23:50:00"), 25), (at("2024-01-31 23:50:00"), None))
    assert [r[0] for r in tuples(df.select(X.add_minutes("t", "m")))] == [at("2024-02-01 00:15:00"), None]


@pytest.mark.parametrize("wide", [False, True])
def test_exact_ratio_rounds_half_up(rows, wide):
    df = rows("a bigint, b bigint", (1, 8), (5, 1000), (15, 1000), (1, 3), (7, 0), (None, 3))
    got = [r[0] for r in tuples(df.select(X.exact_ratio("a", "b", 2, wide)))]
    assert got == [0.13, 0.01, 0.02, 0.33, None, None]


def test_exact_ratio_wide_beyond_bigint(rows):
    df = rows("a bigint, n bigint", (9 * 10**18, 10**9))
    got = df.select(X.exact_ratio("a", F.col("n").cast("decimal(20,0)") * F.lit(3_600_000_000).cast("decimal(11,0)"), 2, True))
    assert tuples(got) == [(2.5,)]


def test_lookup_unknown_and_null(rows):
    df = rows("k string", ("crash",), ("?",), (None,))
    assert [r[0] for r in tuples(df.select(X.lookup("k", {"crash": 1.5}, 1.0)))] == [1.5, 1.0, 1.0]
    assert [r[0] for r in tuples(df.select(X.lookup("k", {"it's": "a'b", "crash": "c"})))] == ["c", None, None]


def test_vehicle_code(rows):
    df = rows("v string, n int", ("Lyft", 1), ("Coco", 60), ("bolt", 123456))
    assert [r[0] for r in tuples(df.select(X.vehicle_code("v", "n")))] == ["LY00001", "CO00060", "BO123456"]


def test_time_features_weekday_is_monday_zero(rows):
    df = X.time_features(rows("t timestamp_ntz", (at("2024-01-01 20:00:00"),)), "t")
    assert tuples(df, "day", "hour", "hour_band", "weekday", "month") == [
        (day("2024-01-01"), 20, "night", 0, day("2024-01-01")),
    ]


def test_constants_are_complete():
    for table in (C.INCIDENT_BAND_MULT, C.STATUS_BAND_MULT, C.TASK_BAND_MULT, C.VENDOR_BAND_BIAS):
        assert all(set(bands) == set(C.HOUR_BANDS) for bands in table.values())
    assert all(len(months) == 12 for months in C.INCIDENT_MONTH_MULT.values())
    assert round(sum(C.INCIDENT_RATE_PER_1K.values()), 10) == 1.46
