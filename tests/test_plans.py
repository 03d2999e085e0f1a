"""Plan shape: no Python in the hot path, no cartesian products, bounded top-k,
one scan for both-ends tables."""

import contextlib
import io
import os
import re

import pytest

from cyclestat import reports
from cyclestat.operators import maps, paths
from cyclestat.operators.facts import path_facts, time_facts
from cyclestat.sources import fixtures
from cyclestat.sources.scratch import fresh_path

SF = os.environ.get("CYCLESTAT_ORACLE_SF", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

FORBIDDEN = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
             "BroadcastNestedLoopJoin", "FlatMapGroupsInPandas", "MapInPandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def trips(spark):
    """The trips as a saved table: plans over files, as in the job."""
    path = fresh_path(spark, "plan-trips")
    fixtures.trips(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(n for n in reports.REPORTS if not n.startswith(("ingest_csv", "ingest_rejects", "trips_table"))))
def test_no_python_or_cartesian(spark, name):
    p = plan(reports.REPORTS[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in p, f"{name}: {bad} in plan"


@pytest.mark.parametrize("name", ["undirected_paths_top100", "path_coords_top1000", "directed_paths_top1000",
                                  "directed_paths_wkdy_am", "directed_paths_wkdy_pm", "directed_paths_wknd"])
def test_top_k_is_take_ordered(trips, name):
    assert "TakeOrderedAndProject" in plan(reports.ON_TRIPS[name](trips))


def test_period_top_k_trims_before_shuffle(trips):
    p = plan(reports.ON_TRIPS["directed_paths_by_period"](trips))
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("k", [150, 1000, 1001, 5000])
def test_ranked_paths_are_cut_before_they_meet(trips, k):
    counts = paths.directed_path_counts(trips)
    p = plan(maps.rank_paths(counts, k, paths.DIRECTED_KEYS))
    assert "TakeOrderedAndProject" in p or "GlobalLimit" in p
    ranked = maps.rank_paths(counts, k, paths.DIRECTED_KEYS).collect()
    assert sorted(r.path_rank for r in ranked) == list(range(1, min(k, counts.count()) + 1))


@pytest.mark.parametrize("k", [150, 1000, 1001, 5000])
def test_groups_are_cut_in_parts_first(trips, k):
    by_period = paths.directed_paths_by_period(trips, k)
    assert re.search(r"hashpartitioning\(period#\d+, _part#\d+", plan(by_period))
    counts = paths.directed_path_counts_by_period(trips).toPandas()
    got = by_period.toPandas()
    for period, own in counts.groupby("period"):
        mine = got[got["period"] == period]
        assert len(mine) == min(k, len(own))
        assert sorted(mine["count"]) == sorted(own["count"].sort_values(ascending=False).head(k))


@pytest.mark.parametrize("name", ["station_uses", "station_lookup", "hourly_usage", "directed_paths_by_period",
                                  "path_coords_top1000", "path_coords_text_top1000", "project_path_coords"])
def test_single_scan(trips, name):
    df = reports.ON_TRIPS[name](trips)
    df.collect()  # the plan that ran: equal exchanges are reused then
    assert len(re.findall(r"FileScan parquet", final_plan(df))) == 1


def final_plan(df):
    """The executed plan without what was planned before adaptive execution."""
    return plan(df).split("+- == Initial Plan ==")[0]


def test_scan_prunes_columns(trips):
    p = plan(reports.ON_TRIPS["hourly_start_weekday"](trips))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"starttime", "stoptime"}


@pytest.mark.parametrize("name", [*reports.ON_PATH_FACTS, *reports.ON_TIME_FACTS])
def test_reports_from_facts_equal_direct_reports(trips, name):
    facts = path_facts(trips) if name in reports.ON_PATH_FACTS else time_facts(trips)
    fn = reports.ON_TRIPS[name]
    direct, grouped = fn(trips), fn(facts)
    assert direct.schema == grouped.schema or direct.dtypes == grouped.dtypes
    assert sorted(map(str, direct.collect())) == sorted(map(str, grouped.collect()))


def ran(df):
    """The final plan of a query that has run."""
    df.collect()
    return plan(df).split("Initial Plan")[0]


def test_trips_are_derived_from_one_scan_and_two_shuffles_of_events(spark):
    p = ran(fixtures.trips(spark, SF))
    assert len(re.findall(r"FileScan parquet \[event_id", p)) == 1
    made = [line for line in p.splitlines() if "ReusedExchange" not in line]
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", "\n".join(made))
    assert len(shuffles) == 2 and not re.search("SortMergeJoin|ShuffledHashJoin", p)
    assert sorted("_seq_chunk" in x for x in shuffles) == [False, True]


def test_the_map_window_reaches_the_scan(spark, trips):
    spark.conf.set("spark.sql.maxMetadataValueLength", "10000")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as told:
            reports.ON_TRIPS["viewport_start_counts"](trips).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.maxMetadataValueLength")
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", told.getvalue())[1]
    for column in ("start_station_longitude", "start_station_latitude"):
        assert f"GreaterThanOrEqual({column}" in pushed and f"LessThanOrEqual({column}" in pushed
