import datetime as dt

from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.operators import paths, stations, usage

T = dt.datetime
COLS = ("starttime timestamp_ntz, stoptime timestamp_ntz, start_station_name string, "
        "start_station_latitude double, start_station_longitude double, end_station_name string, "
        "end_station_latitude double, end_station_longitude double, usertype string")


def trips(spark, rows):
    return spark.createDataFrame(rows, COLS)


def trip(a, b, user="Subscriber", a_xy=(40.7, -74.0), b_xy=(40.71, -74.01), t=T(2024, 1, 8, 8, 30)):
    return (t, t + dt.timedelta(minutes=10), a, a_xy[0], a_xy[1], b, b_xy[0], b_xy[1], user)


def test_undirected_merges_directions_and_share(spark):
    df = trips(spark, [trip("A", "B"), trip("B", "A", "Customer"), trip("A", "B", None), trip("A", "A")])
    got = {r.station_names: (r["count"], r.pct_subscriber) for r in paths.undirected_path_counts(df).collect()}
    assert got["A - B"] == (3, 1 / 3)
    assert got["A - A"] == (1, 1.0)
    assert dict(paths.undirected_path_counts(df).dtypes)["count"] == "bigint"


def test_undirected_binary_order_and_null_group(spark):
    df = trips(spark, [trip("a", "B"), trip(None, "X"), trip("Y", None), trip(None, None)])
    got = {r.station_names: r["count"] for r in paths.undirected_path_counts(df).collect()}
    assert got == {"B - a": 1, None: 3}


def test_split_cuts_separator_inside_name(spark):
    df = trips(spark, [trip("A - B", "C")])
    row = paths.split_path_names(paths.undirected_path_counts(df)).first()
    assert (row.station_1, row.station_2) == ("A", "B")


def test_coordinate_join_fans_out_on_moved_station(spark):
    df = trips(spark, [trip("A", "B", a_xy=(40.7, -74.0)), trip("A", "B", a_xy=(40.7001, -74.0)),
                       trip("B", "C", a_xy=(40.71, -74.01), b_xy=(40.72, -74.02))])
    split = paths.split_path_names(paths.undirected_path_counts(df))
    faithful = paths.path_coordinates(split, stations.station_lookup(df))
    ab = [r for r in faithful.collect() if (r.station_1, r.station_2) == ("A", "B")]
    assert len(ab) == 2 and {r["count"] for r in ab} == {2}
    canon = paths.path_coordinates(split, stations.station_lookup_canonical(df))
    assert canon.where("station_1 = 'A' AND station_2 = 'B'").count() == 1


def test_canonical_lookup_most_used_then_smallest(spark):
    df = trips(spark, [trip("A", "Z", a_xy=(40.70, -74.0)), trip("A", "Z", a_xy=(40.70, -74.0)),
                       trip("A", "Z", a_xy=(40.71, -74.1))])
    lut = {r.start_station_name: (r.start_station_latitude, r.uses)
           for r in stations.station_lookup_canonical(df).collect()}
    assert lut["A"] == (40.70, 2)


def test_station_uses_is_start_plus_end(spark):
    df = trips(spark, [trip("A", "B"), trip("B", "C"), trip("C", "A"), trip("A", "A"), trip(None, "A")])
    uses = {(r.station_name, r.station_longitude, r.station_latitude): r["count"]
            for r in stations.station_uses(df).collect()}
    starts = {tuple(r[:3]): r["count"] for r in stations.start_station_counts(df).collect()}
    ends = {tuple(r[:3]): r["count"] for r in stations.end_station_counts(df).collect()}
    keys = set(starts) | set(ends)
    assert uses == {k: starts.get(k, 0) + ends.get(k, 0) for k in keys}


def test_lookup_distinct_over_both_ends(spark):
    df = trips(spark, [trip("A", "B"), trip("B", "A", a_xy=(40.71, -74.01), b_xy=(40.7, -74.0))])
    assert stations.station_lookup(df).count() == 2
    assert stations.station_lookup(df).columns == [S.START_NAME, S.START_LON, S.START_LAT]


def test_directed_top_k_tie_break_is_deterministic(spark):
    rows = [trip(a, b) for a, b in [("C", "D"), ("A", "B"), ("B", "A"), ("A", "B")]]
    top = paths.directed_paths_top(trips(spark, rows), 2).collect()
    assert [(r.start_station_name, r.end_station_name, r["count"]) for r in top] == [("A", "B", 2), ("B", "A", 1)]


def test_periods_are_disjoint_and_cover_filters(spark):
    mon8, mon17, sat = T(2024, 1, 8, 8, 5), T(2024, 1, 8, 17, 5), T(2024, 1, 13, 12)
    rows = [trip("A", "B", t=mon8), trip("A", "B", t=mon17), trip("A", "B", t=sat), trip("A", "B", t=T(2024, 1, 8, 12))]
    df = trips(spark, rows)
    got = {r.period: r["count"] for r in paths.directed_path_counts_by_period(df).collect()}
    assert got == {"wkdy_am": 1, "wkdy_pm": 1, "wknd": 1}
    assert paths.weekday_morning(df).count() == 1
    assert paths.weekday_evening(df).count() == 1
    assert paths.weekend(df).count() == 1


def test_hours_without_trips_absent(spark):
    df = trips(spark, [trip("A", "B", t=T(2024, 1, 8, 8, 30)), trip("A", "B", t=T(2024, 1, 9, 8, 45))])
    got = [(r.start_hour, r["count"]) for r in usage.hourly_counts(df, "start", "weekday").collect()]
    assert got == [(8, 2)]


def test_hourly_usage_matches_separate_tables(spark):
    rows = [trip("A", "B", t=T(2024, 1, 8, h)) for h in range(0, 24, 5)] + \
           [trip("A", "B", t=T(2024, 1, 13, h)) for h in range(0, 24, 7)]
    df = trips(spark, rows)
    tidy = {(r.day_type, r.series, r.hour): r["count"] for r in usage.hourly_usage(df).collect()}
    for day_type in ("weekday", "weekend"):
        for end, series in (("start", "Start"), ("stop", "Stop")):
            sep = usage.hourly_counts(df, end, day_type).collect()
            assert {(day_type, series, r[0]): r["count"] for r in sep} == \
                {k: v for k, v in tidy.items() if k[:2] == (day_type, series)}


def test_day_of_week_counts_all_trips(spark):
    rows = [trip("A", "B", t=T(2024, 1, 7 + i, 12)) for i in range(7)] + [trip("A", "B", t=T(2024, 1, 13, 23, 59))]
    out = usage.day_of_week_counts(trips(spark, rows)).orderBy("ordinal_number").collect()
    assert [(r.day_of_week, r["count"], r.ordinal_number) for r in out] == [
        ("Sun", 1, 1), ("Mon", 1, 2), ("Tue", 1, 3), ("Wed", 1, 4), ("Thu", 1, 5), ("Fri", 1, 6), ("Sat", 2, 7)]


def test_sum_of_counts_is_row_count(spark):
    rows = [trip(a, b) for a in "ABC" for b in "ABCD"]
    df = trips(spark, rows)
    for agg in (paths.directed_path_counts(df), stations.start_station_counts(df)):
        assert agg.agg(F.sum("count")).first()[0] == len(rows)
    assert paths.undirected_path_counts(df).agg(F.sum("count")).first()[0] == len(rows)


def test_pair_grouping_keeps_names_with_separator_apart(spark):
    df = trips(spark, [trip("A - B", "C"), trip("A", "B - C"), trip("C", "A - B")])
    got = sorted((r.station_1, r.station_2, r["count"], r.station_names)
                 for r in paths.undirected_pair_counts(df).collect())
    assert got == [("A", "B - C", 1, "A - B - C"), ("A - B", "C", 2, "A - B - C")]
    # the text-based route of the source analysis merges and cuts them
    split = paths.split_path_names(paths.undirected_path_counts(df)).collect()
    assert sorted((r.station_1, r.station_2) for r in split) == [("A", "B"), ("A", "B")]


def test_coordinate_variants_and_viewport_stay_on_lookup(spark):
    df = trips(spark, [trip("A", "B", a_xy=(40.7, -74.0)), trip("A", "B", a_xy=(40.7001, -74.0))])
    got = {(r.start_station_name, r.start_station_latitude): r.coordinate_variants
           for r in stations.with_coordinate_variants(stations.station_lookup(df)).collect()}
    assert got == {("A", 40.7): 2, ("A", 40.7001): 2, ("B", 40.71): 1}
