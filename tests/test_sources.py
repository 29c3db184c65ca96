import pathlib

import pytest

from kickstand.schemas import TABLES
from kickstand.sources import readers as R
from kickstand.sources import sinks as S
from tests.conftest import at, day, tuples

AREAS = "service_area_id,community_area_name,area_type\n1,Loop,downtown\n2.0,Hyde Park,\nx,Bad,campus\n"


@pytest.fixture()
def areas_csv(tmp_path):
    path = tmp_path / "areas.csv"
    path.write_text(AREAS)
    return str(path)


def test_typed_csv_binds_by_name(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("per_km,vendor,end_date,start_date\n0.5,Lyft,2024-01-31,2024-01-01\nbad,Lime,,01/02/2024\n")
    table = R.read_table(spark, str(path), "pricing_policies", required=["vendor"])
    assert table.schema == TABLES["pricing_policies"]
    assert tuples(table) == [
        ("Lyft", day("2024-01-01"), day("2024-01-31"), None, None, 0.5),
        ("Lime", day("2024-01-02"), None, None, None, None),
    ]
    with pytest.raises(R.MissingColumns):
        R.read_table(spark, str(path), "vehicles", required=["vehicle_id"])


def test_optional_table(spark):
    missing = R.optional_table(spark, None, "incidents")
    assert missing.schema == TABLES["incidents"] and missing.count() == 0


def test_staging_load_rejects_bad_rows(spark, areas_csv, tmp_path):
    with pytest.raises(ValueError, match="service_area_id"):
        S.staging_load(spark, areas_csv, "service_areas", str(tmp_path / "t1"))
    table = S.staging_load(spark, areas_csv, "service_areas", str(tmp_path / "t2"), str(tmp_path / "bad"))
    assert sorted(tuples(table)) == [(1, "Loop", "downtown"), (2, "Hyde Park", None)]
    bad = R.read_text_csv(spark, str(tmp_path / "bad"))
    assert tuples(bad, "service_area_id", "bad_columns") == [("x", "[service_area_id]")]


def test_extract_has_fixed_columns_and_empty_nulls(spark, rows, tmp_path):
    df = rows("vendor string, incident_id bigint, occurred_at timestamp_ntz", ("Lyft", 1, at("2024-01-01 08:00:00")))
    S.write_named_extract(df, str(tmp_path / "out"), "incidents")
    back = R.read_text_csv(spark, str(tmp_path / "out"))
    assert back.columns == TABLES["incidents"].names
    assert tuples(back, "incident_id", "occurred_at", "resolved_at") == [("1", "2024-01-01 08:00:00", None)]
    typed = R.read_table(spark, str(tmp_path / "out"), "incidents")
    assert tuples(typed, "incident_id", "occurred_at") == [(1, at("2024-01-01 08:00:00"))]


def test_materialized_view_is_partitioned(spark, rows, tmp_path):
    df = rows("month date, vendor string, trips bigint", *[(day(f"2024-0{m}-01"), v, m) for m in (1, 2, 3) for v in "ab"])
    view = S.materialize(spark, df, str(tmp_path / "view"), "month")
    assert sorted(tuples(view, "month", "vendor", "trips")) == sorted(tuples(df))
    assert {p.name for p in (tmp_path / "view").iterdir() if p.is_dir()} == {f"month=2024-0{m}-01" for m in (1, 2, 3)}
    plan = view.filter("month = date '2024-02-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_stored_writes_to_the_shared_folder_once(spark, rows):
    folder = pathlib.Path(S._shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("stored-*"))
    again = S.stored(rows("a int", (1,), (2,)))
    assert sorted(tuples(again)) == sorted(tuples(again)) == [(1,), (2,)]
    assert len(set(folder.glob("stored-*")) - before) == 1
