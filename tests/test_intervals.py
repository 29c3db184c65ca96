"""Days in intervals by dyadic bins, file headers read in one job, and staging in one parse."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kickstand.operators import intervals as IV
from kickstand.schemas import TABLES
from kickstand.sources import readers as R
from kickstand.sources import sinks as S
from tests.conftest import at, day, tuples

POLICY = "vendor string, start_date date, end_date date, base_fare double, per_minute double, per_km double"


def test_bins_cover_an_interval_once(spark):
    rng = random.Random(2)
    pairs = [(0, 0), (0, 1), (1, 1), (0, (1 << 22) - 1), (5, 12)] + [tuple(sorted(rng.randrange(3_600_000) for _ in range(2))) for _ in range(60)]
    short = [(a, a + rng.randrange(200)) for a, _ in pairs]
    frame = spark.createDataFrame(pairs + short, "a long, b long").select("a", "b", IV.dyadic_bins(F.col("a"), F.col("b")).alias("bins"))
    for a, b, bins in frame.collect():
        held = sorted((r["bin"] << r["level"], (r["bin"] + 1) << r["level"]) for r in bins)
        assert held[0][0] == a and held[-1][1] == b + 1
        assert all(x[1] == y[0] for x, y in zip(held, held[1:]))
        assert len(bins) <= 2 * (b - a + 1).bit_length()


def test_an_open_policy_costs_few_rows(rows):
    open_ended = rows(POLICY, ("Lime", day("2024-01-01"), None, 1.0, 0.0, 0.0))
    assert IV.bins_of(open_ended, "vendor").count() < 40


def test_the_latest_policy_holds(rows):
    rng = random.Random(5)
    first = dt.date(2023, 1, 1)
    policies = [
        (rng.choice("ab"), first + dt.timedelta(rng.randrange(500)), rng.choice([None, first + dt.timedelta(rng.randrange(700))]), float(i), 0.0, 0.0)
        for i in range(40)
    ]
    policies += [(None, first, None, 99.0, 0.0, 0.0), ("a", None, None, 98.0, 0.0, 0.0)]
    points = [(v, first + dt.timedelta(d)) for v in ("a", "b", "c") for d in range(-20, 800, 3)] + [(None, first), ("a", None)]
    got = {(r["vendor"], r["day"]): r["base_fare"] for r in IV.in_force(rows("vendor string, day date", *points, *points), rows(POLICY, *policies), "vendor", "day").collect()}
    want = {}
    for v, d in points:
        fits = [p for p in policies if v and d and p[0] == v and p[1] and p[1] <= d <= (p[2] or dt.date(2100, 12, 31))]
        if fits:
            want[v, d] = min(fits, key=lambda p: (-p[1].toordinal(), p[2] or dt.date(2100, 12, 31), p[3]))[3]
    assert got == want


def test_revenue_counts_unpriced_days(rows):
    trips = rows(
        "vendor string, started_at timestamp_ntz, duration_s int, distance_m int",
        ("Lime", at("2024-01-05 10:00"), 60, 1000),
        ("Lime", at("2024-01-25 10:00"), 60, 1000),
        ("Lime", at("2023-12-25 10:00"), 60, 1000),
        ("Spin", at("2024-01-05 10:00"), 60, 1000),
    )
    pricing = rows(POLICY, ("Lime", day("2024-01-01"), None, 1.0, 1.0, 1.0), ("Lime", day("2024-01-20"), day("2024-01-31"), 2.0, 0.0, 0.0))
    assert sorted(tuples(IV.revenue_by_vendor_month(trips, pricing), "vendor", "month", "trips", "unpriced_trips", "revenue")) == [
        ("Lime", day("2023-12-01"), 0, 1, None),
        ("Lime", day("2024-01-01"), 2, 0, 5.0),
        ("Spin", day("2024-01-01"), 0, 1, None),
    ]


# --- many files -------------------------------------------------------------------


def _jobs(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        return out, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_headers_of_five_hundred_files_take_jobs_by_header_not_by_file(spark, tmp_path):
    heads = ["a,b,c", "c,a", "b,d"]
    for i in range(500):
        head = heads[i % 3]
        (tmp_path / f"f{i:03}.csv").write_text(head + "\n" + ",".join(f"{c}{i}" for c in head.split(",")) + "\n")
    frame, jobs = _jobs(spark, lambda: R.read_text_csv(spark, str(tmp_path / "*.csv")))
    # the headers, and per header its columns and Spark's listing of its files
    assert jobs <= 4 * len(heads)
    assert sorted(frame.columns) == ["a", "b", "c", "d"]
    got = {tuple(r[c] for c in "abcd") for r in frame.collect()}
    assert got == {tuple(f"{c}{i}" if c in heads[i % 3].split(",") else None for c in "abcd") for i in range(500)}


def test_headers_with_quotes_line_ends_and_compression(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_bytes(b'"x","long name"\r\n1,2\r\n')
    (tmp_path / "b.csv").write_bytes(b"x,long name\n3,4\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"long name\n5\n"))
    (tmp_path / "d.csv").write_bytes(b"x,long name")
    assert sorted(tuples(R.read_text_csv(spark, str(tmp_path)), "x", "long name"), key=str) == [("1", "2"), ("3", "4"), (None, "5")]


# --- staging ----------------------------------------------------------------------


def test_staging_parses_the_text_once(spark, tmp_path):
    path = tmp_path / "areas.csv"
    path.write_text("service_area_id,extra,community_area_name,area_type\n1,e,Loop,downtown\nx,f,Bad,\n2.0,g,,campus\n")
    table, jobs = _jobs(spark, lambda: S.staging_load(spark, str(path), "service_areas", str(tmp_path / "t"), str(tmp_path / "bad")))
    # the header, the one pass over the text, and the rejected rows from the staged files
    assert jobs <= 3
    assert table.schema == TABLES["service_areas"] and sorted(tuples(table)) == [(1, "Loop", "downtown"), (2, None, "campus")]
    bad = R.read_text_csv(spark, str(tmp_path / "bad"))
    assert bad.columns == ["service_area_id", "extra", "community_area_name", "area_type", "bad_columns"]
    assert tuples(bad) == [("x", "f", "Bad", None, "[service_area_id]")]


def test_a_failed_load_leaves_the_target_as_it_was(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("service_area_id\n1\n")
    bad.write_text("service_area_id\n2\nx\n")
    S.staging_load(spark, str(good), "service_areas", str(tmp_path / "t"))
    with pytest.raises(ValueError, match="service_area_id"):
        S.staging_load(spark, str(bad), "service_areas", str(tmp_path / "t"))
    assert [r["service_area_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]


def test_loads_of_nothing(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("service_area_id,area_type\n")
    assert S.staging_load(spark, str(path), "service_areas", str(tmp_path / "t"), str(tmp_path / "bad")).count() == 0
    path.write_text("service_area_id,area_type\nx,\n")
    assert S.staging_load(spark, str(path), "service_areas", str(tmp_path / "t"), str(tmp_path / "bad")).count() == 0
