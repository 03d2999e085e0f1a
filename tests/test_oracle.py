"""Every registered report equals its DuckDB oracle on the sf0.01 tables."""

import os

import pytest

import __spark_entry__ as E
from compare import _norm, compare, duck
from cyclestat import reports

SF = os.environ.get("CYCLESTAT_ORACLE_SF", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_report_is_registered_with_an_oracle():
    assert set(reports.REPORTS) <= set(E.queries()) & set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_report_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["station_1", "station_2", "count", "lat_1", "lon_1", "lon_2", "lat_2"]
    assert df.count() > 0


SORTED = ["station_lookup", "start_station_counts", "end_station_counts", "hourly_start_weekday", "hourly_stop_weekday",
          "hourly_start_weekend", "hourly_stop_weekend", "day_of_week_counts", "undirected_path_counts", "undirected_paths_top100",
          "path_coords_top1000", "path_coords_text_top1000", "directed_paths_top1000", "directed_paths_wkdy_am",
          "directed_paths_wkdy_pm", "directed_paths_wknd"]


@pytest.mark.parametrize("name", SORTED)
def test_sorted_report_comes_in_the_oracle_order(spark, con, name):
    got = E.queries()[name](spark, SF)
    want = con.sql(E.oracle_sql()[name])
    assert [tuple(_norm(v) for v in r) for r in got.select(*want.columns).collect()] == [tuple(_norm(v) for v in r) for r in want.fetchall()]


def test_hard_values_are_in_the_fixture(spark):
    t = reports.REPORTS["trips"](spark, SF)
    length = "unix_seconds(cast(stoptime AS timestamp)) - unix_seconds(cast(starttime AS timestamp))"
    for condition in ("start_station_name IS NULL", "end_station_name IS NULL", "usertype IS NULL", "stoptime IS NULL",
                      "start_station_name LIKE '% - %'", f"{length} = -60", f"{length} = 86400"):
        assert t.where(condition).count() > 0, condition
