"""Remaining semantic rules of SURVEY §1.3 (S1, S13, S14, S17, S18)."""

import datetime as dt

from cyclestat import schema as S
from cyclestat.operators import ingest, maps, paths, stations

T = dt.datetime
COLS = ("starttime timestamp_ntz, stoptime timestamp_ntz, start_station_name string, "
        "start_station_latitude double, start_station_longitude double, end_station_name string, "
        "end_station_latitude double, end_station_longitude double, usertype string")


def trip(a, b, a_xy=(40.7, -74.0), b_xy=(40.71, -74.01)):
    t = T(2024, 1, 8, 8)
    return (t, t + dt.timedelta(minutes=5), a, a_xy[0], a_xy[1], b, b_xy[0], b_xy[1], "Subscriber")


def test_s1_misspelt_stop_column_maps_to_canonical(spark):
    df = spark.createDataFrame([("x", "y")], "`starttime` string, `stopttime` string")
    assert ingest.normalise_headers(df).columns == ["starttime", "stoptime"]
    assert S.canonical_name("Stop Time") == "stoptime"


def test_s13_coordinate_join_drops_null_and_unknown_names(spark):
    df = spark.createDataFrame([trip("A", "B"), trip(None, "B"), trip("A", None)], COLS)
    pairs = paths.undirected_pair_counts(df)
    lut = spark.createDataFrame([("A", -74.0, 40.7)], "start_station_name string, "
                                "start_station_longitude double, start_station_latitude double")
    assert paths.path_coordinates(pairs, lut).count() == 0          # B unknown, NULL pair dropped
    assert paths.path_coordinates(pairs, stations.station_lookup(df)).count() == 1


def test_s14_negative_zero_coordinate_groups_with_zero(spark):
    df = spark.createDataFrame([trip("A", "B", a_xy=(40.7, 0.0)), trip("A", "B", a_xy=(40.7, -0.0))], COLS)
    assert stations.start_station_counts(df).count() == 1


def test_s17_column_order_per_operator(spark):
    df = spark.createDataFrame([trip("A", "B")], COLS)
    assert stations.start_station_counts(df).columns == [S.START_NAME, S.START_LON, S.START_LAT, "count"]
    assert stations.end_station_counts(df).columns == [S.END_NAME, S.END_LON, S.END_LAT, "count"]
    assert stations.station_uses(df).columns == ["station_name", "station_longitude", "station_latitude", "count"]
    assert paths.directed_path_counts(df).columns == [S.START_NAME, S.START_LAT, S.START_LON,
                                                      S.END_NAME, S.END_LAT, S.END_LON, "count"]
    coords = paths.path_coordinates(paths.undirected_pair_counts(df), stations.station_lookup(df))
    assert coords.columns == ["station_1", "station_2", "count", "lat_1", "lon_1", "lon_2", "lat_2"]


def test_s18_projection_adds_columns_and_keeps_degrees(spark):
    df = spark.createDataFrame([trip("A", "B")], COLS)
    out = maps.project_paths(paths.directed_path_counts(df))
    assert out.columns[-4:] == ["start_x_ft", "start_y_ft", "end_x_ft", "end_y_ft"]
    r = out.first()
    assert (r.start_station_latitude, r.start_station_longitude) == (40.7, -74.0)
    assert abs(r.start_x_ft - 984250.0) < 1e-6                    # on the central meridian
