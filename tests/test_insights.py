"""States that roll up, refreshed views, trends, best-in-class sets, alerts and absences, on small tables."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kickstand import constants as C
from kickstand.operators import absences as AB
from kickstand.operators import insights as IN
from kickstand.operators import rollups as RU
from kickstand.plans.monthly_view import ChangedInput, MonthlyView
from kickstand.plans.monthly_view import _per_month
from tests.conftest import at, day

TRIPS = "trip_id bigint, vendor string, started_at timestamp_ntz, service_area_id int"
MOVES = "event_id bigint, vehicle_id string, event_time timestamp_ntz, event_type string"
OUT, BACK = "maintenance_pickup", "maintenance_dropoff"


# --- refreshed view ---------------------------------------------------------------


def _view(spark, root, read):
    def reader(session, files):
        read.append(sorted(f.rsplit("/", 1)[-1] for f in files))
        return session.read.schema(TRIPS.replace("bigint", "long")).parquet(*files)

    return MonthlyView(spark, f"{root}/view", {"trips": reader})


def _drop(rows, folder, *data):
    rows(TRIPS, *data).coalesce(1).write.mode("append").parquet(str(folder))


def _rows(view):
    return sorted((str(r["month"]), r["vendor"], r["trips"]) for r in view.read().collect())


def test_refresh_reads_new_files_only_and_equals_a_full_build(spark, rows, tmp_path):
    files, read = tmp_path / "trips", []
    view = _view(spark, tmp_path, read)
    assert view.refresh(trips=str(files)) == [] and view.read().count() == 0
    _drop(rows, files, (1, "Lime", at("2024-01-05 10:00"), 1), (2, "Lime", at("2024-01-06 10:00"), 2), (3, "Spin", at("2024-02-01 00:00"), 1))
    first = view.refresh(trips=str(files))
    assert _rows(view) == [("2024-01-01", "Lime", 2), ("2024-02-01", "Spin", 1)]
    untouched = {p.name for p in (tmp_path / "view/state/month=2024-02-01").glob("*.parquet")}
    assert view.refresh(trips=str(files)) == [] and len(read) == 1
    _drop(rows, files, (4, "Lime", at("2024-01-31 23:59"), 1), (5, None, at("2024-03-01 00:00"), 1), (6, "Spin", None, 1))
    second = view.refresh(trips=str(files))
    assert len(second) == 1 and not {f[1] for f in second} & {f[1] for f in first} and len(read) == 2
    assert _rows(view) == [("2024-01-01", "Lime", 3), ("2024-02-01", "Spin", 1), ("2024-03-01", "Coco", 1)]
    assert {p.name for p in (tmp_path / "view/state/month=2024-02-01").glob("*.parquet")} == untouched
    whole = _view(spark, tmp_path / "other", [])
    whole.refresh(trips=str(files))
    assert _rows(whole) == _rows(view)


def test_a_refresh_that_stopped_before_merging_is_finished_by_the_next(spark, rows, tmp_path, monkeypatch):
    files = tmp_path / "trips"
    view = _view(spark, tmp_path, [])
    _drop(rows, files, (1, "Lime", at("2024-01-05 10:00"), 1))
    view.refresh(trips=str(files))
    _drop(rows, files, (2, "Lime", at("2024-01-06 10:00"), 1), (3, "Lime", at("2024-02-06 10:00"), 1))
    with monkeypatch.context() as m:
        m.setattr(MonthlyView, "merge", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            view.refresh(trips=str(files))
    assert _rows(view) == [("2024-01-01", "Lime", 1)]
    assert view.refresh(trips=str(files)) == []
    assert _rows(view) == [("2024-01-01", "Lime", 2), ("2024-02-01", "Lime", 1)]
    view.merge()
    assert _rows(view) == [("2024-01-01", "Lime", 2), ("2024-02-01", "Lime", 1)]


def test_a_changed_file_is_refused(spark, rows, tmp_path):
    files = tmp_path / "trips"
    view = _view(spark, tmp_path, [])
    _drop(rows, files, (1, "Lime", at("2024-01-05 10:00"), 1))
    view.refresh(trips=str(files))
    (part,) = files.glob("*.parquet")
    part.write_bytes(part.read_bytes() + b"x")
    for crc in files.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ChangedInput):
        view.refresh(trips=str(files))


def test_sums_of_empty_costs_are_zero(rows):
    held = rows("vendor string, occurred_at timestamp_ntz, cost_usd int", ("Lime", at("2024-01-05 10:00"), None))
    got = _per_month(held, "occurred_at", cents=F.sum(F.col("cost_usd") * 100)).first()
    assert (got["vendor"], got["cents"]) == ("Lime", 0)


# --- states -----------------------------------------------------------------------


def test_sketches_of_days_roll_up_within_their_error(spark):
    rng = random.Random(7)
    data = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 90)), rng.choice("ab"), f"V{rng.randrange(9000)}", int(rng.paretovariate(1.1) * 100) % 50_000) for _ in range(60_000)]
    events = spark.createDataFrame(data, "time timestamp_ntz, vendor string, id string, metres int")
    states = RU.daily_states(events, "time", ["vendor"], ["id"], ["metres"])
    assert states.count() == 180
    got = {r["start"]: r["n"] for r in RU.roll_up(states, "month").select("start", RU.distinct_estimate("id").alias("n")).collect()}
    for start, n in got.items():
        exact = len({i for t, _, i, _ in data if t.date().replace(day=1) == start})
        assert abs(n - exact) <= RU.DISTINCT_ERROR * exact
    whole = RU.roll_up(states, "month", ["vendor"]).withColumn("p90", RU.quantile_estimate("metres", 0.9))
    for r in whole.collect():
        held = sorted(m for t, v, _, m in data if v == r["vendor"] and t.date().replace(day=1) == r["start"])
        below, upto = sum(m < r["p90"] for m in held), sum(m <= r["p90"] for m in held)
        assert below / len(held) <= 0.9 + RU.RANK_ERROR and upto / len(held) >= 0.9 - RU.RANK_ERROR and r["rows"] == len(held)


def test_cube_of_measures_that_do_not_add_up(rows):
    data = [("Lime", "crash", "V1", 4, 10), ("Lime", "theft", "V1", 6, None), (None, "crash", "V2", 1, 7), (None, "crash", None, None, 1), ("Spin", None, "V1", 9, 2)]
    held = rows("vendor string, kind string, vehicle_id string, minutes int, cost int", *data)
    got = RU.cube_of(
        held,
        ["vendor", "kind"],
        additive={"n": F.count("*")},
        ratios={"mean": (F.sum("cost"), F.count("cost"), 2)},
        distinct={"vehicles": "vehicle_id"},
        percentiles={"p50": ("minutes", 5, 1)},
    )
    found = {(r["vendor_all"], r["kind_all"], r["vendor"], r["kind"]): (r["n"], r["mean"], r["vehicles"], r["p50"]) for r in got.collect()}
    want = {}
    for whole in ((0, 0), (0, 1), (1, 0), (1, 1)):
        for row in data:
            key = (*whole, None if whole[0] else row[0], None if whole[1] else row[1])
            want.setdefault(key, []).append(row)
    assert set(found) == set(want)
    for key, held in want.items():
        costs, minutes = [r[4] for r in held if r[4] is not None], [r[3] for r in held if r[3] is not None]
        n, mean, vehicles, p50 = found[key]
        assert (n, vehicles) == (len(held), len({r[2] for r in held if r[2]}))
        assert mean == (int(sum(costs) * 100 / len(costs) + 0.5) / 100 if costs else None)
        assert p50 == (statistics.median(minutes) if minutes else None)


def test_cube_of_nothing_is_empty(rows):
    assert RU.cube_of(rows("vendor string, id string", ("Lime", "a")).limit(0), ["vendor"], {"n": F.count("*")}, distinct={"ids": "id"}).filter("vendor_all = 0").count() == 0


# --- trend, skyline, alerts -------------------------------------------------------


def test_trend_marks_points_far_above_the_line(rows):
    points = [("a", i, float(i), 2.0 * i + 1) for i in range(20)] + [("a", 99, 10.0, 60.0), ("a", 100, None, 1.0), ("b", 1, 1.0, 1.0), ("c", 1, 2.0, 1.0), ("c", 2, 2.0, 5.0), ("c", 3, 2.0, 9.0)]
    held = rows("vendor string, area int, x double, y double", *points)
    got = {(r["vendor"], r["area"]): r for r in IN.trend(held, "x", "y", ["vendor"]).collect()}
    xs, ys = zip(*[(x, y) for v, _, x, y in points if v == "a" and x is not None], strict=True)
    line = statistics.linear_regression(xs, ys)
    assert got["a", 3]["slope"] == pytest.approx(line.slope, abs=1e-6) and got["a", 3]["intercept"] == pytest.approx(line.intercept, abs=1e-4)
    assert [k for k, r in got.items() if r["above_trend"]] == [("a", 99)]
    assert len(got) == len(points) and got["a", 100]["residual"] is None
    assert got["b", 1]["slope"] is None and got["c", 1]["slope"] is None


@pytest.mark.parametrize("tasks", [1, 5])
def test_skyline_equals_all_pairs(rows, tasks):
    rng = random.Random(9)
    points = [(rng.choice("ab"), i, rng.randrange(12) / 10, rng.choice([None, *range(12)])) for i in range(300)]
    held = rows("vendor string, area int, x double, y int", *points)
    got = {r["area"] for r in IN.skyline(held, "x", "y", ["vendor"], tasks=tasks).collect()}

    def beats(p, q):
        return p[0] == q[0] and p[3] is not None and p[2] <= q[2] and p[3] <= q[3] and (p[2] < q[2] or p[3] < q[3])

    assert got == {q[1] for q in points if q[3] is not None and not any(beats(p, q) for p in points)}


def test_alerts_take_limits_that_outliers_do_not_move(rows):
    rng = random.Random(1)
    data = [(day("2024-01-01"), h % 24, h, "Lime", 10 + rng.randrange(5), 11.25) for h in range(400)]
    data += [(day("2024-01-02"), 8, 9, "Lime", 500, 11.25), (day("2024-01-02"), 8, 10, "Lime", 12, None), (day("2024-01-02"), 8, 9, "Spin", 3, 2.0)]
    held = rows("day date, hour int, service_area_id int, vendor string, trips bigint, expected_trips double", *data)
    got = {(r["day"].day, r["service_area_id"], r["vendor"]): r for r in IN.demand_alerts(held).collect()}
    groups = {}
    for d, hour, area, vendor, trips, expected in data:
        if expected is not None:
            name = next(n for n, last in C.HOUR_BANDS.items() if hour <= last)
            groups.setdefault((vendor, name), []).append(((d.day, area, vendor), trips - expected))
    want = {}
    for held in groups.values():
        middle = statistics.median(g for _, g in held)
        away = statistics.median(abs(g - middle) for _, g in held)
        want |= {key: (middle, away) for key, g in held if g - middle > 3 * 1.4826 * away}
    assert (2, 9, "Lime") in want
    assert {k: (r["median_gap"], r["median_distance"]) for k, r in got.items()} == want


# --- absences ---------------------------------------------------------------------


def test_vehicles_out_by_hour_merges_repeated_pickups(rows):
    moves = [
        (1, "V1", at("2024-01-01 10:10"), OUT),
        (2, "V1", at("2024-01-02 11:00"), OUT),
        (3, "V1", at("2024-01-04 09:30"), BACK),
        (4, "V1", at("2024-01-04 09:40"), BACK),
        (5, "V2", at("2024-01-01 10:50"), BACK),
        (6, "V2", at("2024-01-02 23:59"), OUT),
        (7, "V3", at("2024-01-03 00:00"), OUT),
        (8, "V3", at("2024-01-03 00:00"), BACK),
        (9, "V4", None, OUT),
        (10, None, at("2024-01-03 01:00"), OUT),
        (11, "V5", at("2024-01-05 01:00"), "offline"),
    ]
    got = {(r["day"].day, r["hour"]): r for r in AB.vehicles_out_by_hour(rows(MOVES, *moves)).collect()}
    assert set(got) == {(d, h) for d in range(1, 5) for h in range(24)}

    def out_at(time):
        held, out = {}, 0
        for _, v, t, kind in sorted((m for m in moves if m[1] and m[2] and m[3] != "offline"), key=lambda m: (m[2], m[0])):
            if t < time:
                held[v] = kind == OUT
        return out + sum(held.values())

    for (d, h), r in got.items():
        start = dt.datetime(2024, 1, d, h)
        assert r["out_at_start"] == out_at(start), (d, h)
        assert r["out_at_end"] == out_at(start + dt.timedelta(hours=1)), (d, h)
    assert (got[3, 0]["went_out"], got[3, 0]["came_back"]) == (1, 1)


def test_absences_of_nothing(rows):
    assert AB.vehicles_out_by_hour(rows(MOVES, (1, "V1", at("2024-01-01 10:10"), BACK))).count() == 0
