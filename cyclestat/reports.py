"""The named reports of the trip analysis, each ``(spark, data_dir) -> DataFrame``.

Reports are sorted where the source analysis sorts (counts descending,
hours, names, days); sets it returns unsorted stay unsorted, which saves a
sampling job and a global sort each.

Every report reads the trips derived from the data folder's tables (see
:mod:`cyclestat.sources.fixtures`) and is built only from library operators;
this module holds no logic of its own beyond wiring and display order.  The
aggregate reports take trips or the facts of :mod:`cyclestat.operators.facts`
(``ON_PATH_FACTS``, ``ON_TIME_FACTS``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.functions.calendar import epoch_seconds, trip_length_seconds
from cyclestat.functions.timeparse import LAYOUTS, parse_trip_time, render_trip_time
from cyclestat.operators import calendar, ingest, maps, paths, stations, usage
from cyclestat.operators.facts import path_facts
from cyclestat.plans.counting import TRIP_COUNT
from cyclestat.sources import csv_trips, fixtures, tables
from cyclestat.sources.scratch import warehouse_path

Report = Callable[[SparkSession, str], DataFrame]
TripReport = Callable[[DataFrame], DataFrame]

FEET_DECIMALS = 3


def _trips(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.trips(spark, d)


def _facts(t: DataFrame) -> DataFrame:
    """Path facts of trips; facts as they are.  For reports that read them twice."""
    return t if TRIP_COUNT in t.columns else path_facts(t)


def _by_count(df: DataFrame, keys) -> DataFrame:
    return df.orderBy(F.col("count").desc(), *[F.col(k).asc_nulls_first() for k in keys])


# --- trips and calendar -------------------------------------------------------

def trips(t: DataFrame) -> DataFrame:
    return t


def trip_calendar(t: DataFrame) -> DataFrame:
    return calendar.with_trip_calendar(t)


def weekday_trips(t: DataFrame) -> DataFrame:
    return calendar.weekday_trips(t)


def weekend_trips(t: DataFrame) -> DataFrame:
    return calendar.weekend_trips(t)


# --- stations -----------------------------------------------------------------

def station_lookup(t: DataFrame) -> DataFrame:
    return stations.station_lookup(t, ordered=True)


def station_lookup_canonical(t: DataFrame) -> DataFrame:
    return stations.station_lookup_canonical(t)


def start_station_counts(t: DataFrame) -> DataFrame:
    return _by_count(stations.start_station_counts(t), stations.START_KEYS)


def end_station_counts(t: DataFrame) -> DataFrame:
    return _by_count(stations.end_station_counts(t), stations.END_KEYS)


def station_uses(t: DataFrame) -> DataFrame:
    # unordered, like the source's station-use table
    return stations.station_uses(t)


def station_use_rows(t: DataFrame) -> DataFrame:
    return stations.station_use_rows(t)


# --- time of use --------------------------------------------------------------

def _hourly(end: str, day_type: str) -> TripReport:
    name = f"{end}_hour"
    return lambda t: usage.hourly_counts(t, end, day_type).orderBy(name)


hourly_start_weekday = _hourly("start", "weekday")
hourly_stop_weekday = _hourly("stop", "weekday")
hourly_start_weekend = _hourly("start", "weekend")
hourly_stop_weekend = _hourly("stop", "weekend")


def hourly_usage(t: DataFrame) -> DataFrame:
    return usage.hourly_usage(t)


def day_of_week_counts(t: DataFrame) -> DataFrame:
    return usage.day_of_week_counts(t).orderBy("ordinal_number")


# --- paths --------------------------------------------------------------------

def undirected_path_counts(t: DataFrame) -> DataFrame:
    return _by_count(paths.undirected_path_counts(t), ["station_names"])


def undirected_paths_top100(t: DataFrame) -> DataFrame:
    return paths.undirected_paths_top(t, S.TOP_UNDIRECTED)


def undirected_path_split(t: DataFrame) -> DataFrame:
    return paths.split_path_names(paths.undirected_path_counts(t))


def path_coords_top1000(t: DataFrame) -> DataFrame:
    f = _facts(t)
    return paths.path_coordinates_top(paths.undirected_pair_counts(f), stations.station_lookup(f), S.TOP_PATHS)


def path_coords_text_top1000(t: DataFrame) -> DataFrame:
    """The same by way of the joined text, as in the source analysis: names are
    split out of it again, so one that holds the separator is cut."""
    f = _facts(t)
    split = paths.split_path_names(paths.undirected_text_counts(f))
    return paths.path_coordinates_top(split, stations.station_lookup(f), S.TOP_PATHS)


def directed_paths_top1000(t: DataFrame) -> DataFrame:
    return paths.directed_paths_top(t, S.TOP_PATHS)


def directed_paths_wkdy_am(t: DataFrame) -> DataFrame:
    return paths.directed_paths_top(paths.weekday_morning(t), S.TOP_PATHS)


def directed_paths_wkdy_pm(t: DataFrame) -> DataFrame:
    return paths.directed_paths_top(paths.weekday_evening(t), S.TOP_PATHS)


def directed_paths_wknd(t: DataFrame) -> DataFrame:
    return paths.directed_paths_top(paths.weekend(t), S.TOP_PATHS)


def directed_paths_by_period(t: DataFrame) -> DataFrame:
    return paths.directed_paths_by_period(t, S.MAP_PATHS)


# --- maps ---------------------------------------------------------------------

def project_stations(t: DataFrame) -> DataFrame:
    uses = stations.station_uses(t)
    return maps.project_stations(uses, decimals=FEET_DECIMALS)


def project_start_stations(t: DataFrame) -> DataFrame:
    return maps.project_stations(stations.start_station_counts(t), "start_station", decimals=FEET_DECIMALS)


def project_end_stations(t: DataFrame) -> DataFrame:
    return maps.project_stations(stations.end_station_counts(t), "end_station", decimals=FEET_DECIMALS)


def project_paths(t: DataFrame) -> DataFrame:
    top = paths.directed_paths_top(t, S.TOP_PATHS)
    return maps.project_paths(top, decimals=FEET_DECIMALS)


def stations_in_viewport(t: DataFrame) -> DataFrame:
    lut = stations.with_coordinate_variants(stations.station_lookup(t))
    projected = maps.with_projection(lut, S.START_LON, S.START_LAT, "x_ft", "y_ft")
    inside = maps.stations_in_viewport(projected)
    return inside.withColumns({c: F.round(c, FEET_DECIMALS) for c in ("x_ft", "y_ft")})


def viewport_start_counts(t: DataFrame) -> DataFrame:
    """Trips per start station within the map window."""
    return stations.start_station_counts(maps.trips_in_viewport(t))


def path_kind(t: DataFrame) -> DataFrame:
    top = paths.directed_paths_top(t, S.TOP_PATHS)
    return top.withColumn("path_kind", maps.path_kind())


def path_segments(t: DataFrame) -> DataFrame:
    counts = paths.directed_path_counts(t)
    ranked = maps.rank_paths(counts, S.MAP_PATHS, paths.DIRECTED_KEYS)
    segs = maps.path_segments(maps.project_paths(ranked), S.POINTS_PER_PATH)
    return segs.withColumns({c: F.round(c, FEET_DECIMALS) for c in ("x_ft", "y_ft")})


def project_path_coords(t: DataFrame) -> DataFrame:
    """The undirected path map: first 100 rows of the coordinate table (after
    fan-out, as drawn), both ends projected, loop or segment."""
    f = _facts(t)
    top = paths.path_coordinates_top(paths.undirected_pair_counts(f), stations.station_lookup(f),
                                     S.TOP_UNDIRECTED)
    return maps.project_path_coordinates(top, decimals=FEET_DECIMALS) \
        .withColumn("path_kind", maps.path_kind("station_1", "station_2"))


def period_path_segments(t: DataFrame) -> DataFrame:
    """Line geometry of the three period maps (top 150 paths each)."""
    ranked = paths.directed_paths_by_period(t, S.MAP_PATHS)
    segs = maps.path_segments(maps.project_paths(ranked), S.POINTS_PER_PATH, rank_col="rank",
                              carry=("period",))
    return segs.withColumns({c: F.round(c, FEET_DECIMALS) for c in ("x_ft", "y_ft")})


def period_scale_limit(t: DataFrame) -> DataFrame:
    return maps.scale_limit(paths.directed_path_counts_by_period(t))


# --- ingest -------------------------------------------------------------------

def ingest_mixed_timestamps(spark, d):
    t = _trips(spark, d)
    frames = [t.select("trip_id", F.lit(layout).alias("layout"),
                       *[parse_trip_time(render_trip_time(c, layout)).alias(c) for c in S.TIME_COLUMNS])
              for layout in LAYOUTS]
    return ingest.union_positional(frames)


def _raw_feeds(spark, d):
    t = _trips(spark, d)
    return [(month, fixtures.render_raw_feed(t, header, layout, month))
            for month, header, layout in fixtures.FEED_GENERATIONS]


def ingest_header_normalise(spark, d):
    t = _trips(spark, d)
    return ingest.normalise_headers(fixtures.render_raw_feed(t, "titled", "us", "2016-10"))


def ingest_header_variants(spark, d):
    t = _trips(spark, d)
    raws = [fixtures.render_raw_feed(t, "classic", "iso", "2013-07"),
            fixtures.render_raw_feed(t, "titled", "us", "2016-10")]
    return ingest.repair_trips(ingest.union_positional(ingest.normalise_headers(r) for r in raws))


def ingest_trips(spark, d):
    raws = [ingest.normalise_headers(r) for _, r in _raw_feeds(spark, d)]
    return ingest.repair_trips(ingest.union_positional(raws))


def ingest_time_rejects(spark, d):
    """Unparsable time text per feed month: the three valid generations, one month
    written day-first by mistake and one with malformed start times."""
    raws = [ingest.normalise_headers(r) for _, r in _raw_feeds(spark, d)]
    raws.append(ingest.normalise_headers(fixtures.render_day_first_feed(_trips(spark, d), "2015-06")))
    raws.append(ingest.normalise_headers(fixtures.render_malformed_times(_trips(spark, d), "2015-07")))
    return ingest.time_rejects(ingest.union_positional(raws), group_by="source_month")


#: A zone whose clocks change, and the days before its two changes of a year.
CLOCK_ZONE, CLOCK_CHANGES = "America/New_York", ("2024-03-09 00:00:00", "2024-11-02 00:00:00")


def elapsed_lengths(spark, d):
    """Trips of up to two days moved to the two clock changes of a year, with their length by the wall
    clock and the time that passed."""
    t = _trips(spark, d)
    spring, autumn = (F.lit(x).cast("timestamp_ntz") for x in CLOCK_CHANGES)
    wall = trip_length_seconds(S.STARTTIME, S.STOPTIME)
    day = F.when(F.col("trip_id") % 2 == 0, spring).otherwise(autumn)
    start = day + F.make_dt_interval(days=F.lit(0), secs=(epoch_seconds(S.STARTTIME) % (2 * S.MAX_TRIP_SECONDS)).cast("decimal(18,6)"))
    moved = t.where(wall.between(0, 2 * S.MAX_TRIP_SECONDS)).select("trip_id", start.alias(S.STARTTIME), wall.alias("wall_sec"))
    stop = F.col(S.STARTTIME) + F.make_dt_interval(days=F.lit(0), secs=F.col("wall_sec").cast("decimal(18,6)"))
    moved = moved.withColumn(S.STOPTIME, stop)
    return moved.select("trip_id", S.STARTTIME, S.STOPTIME, "wall_sec", trip_length_seconds(S.STARTTIME, S.STOPTIME, CLOCK_ZONE).alias("elapsed_sec"))


def _own_name(kind: str, d: str) -> str:
    """One stable name per data folder, replaced by each call."""
    return f"cyclestat_{kind}_{hashlib.sha1(d.encode()).hexdigest()[:12]}"


def ingest_csv(spark, d):
    """Three months under their real object names, in both naming styles."""
    base = warehouse_path(spark, _own_name("feed", d))
    files = []
    for month, raw in _raw_feeds(spark, d):
        path = csv_trips.feed_paths(base, month, month)[0]
        raw.write.mode("overwrite").option("header", True).csv(path)
        files.append(path)
    return csv_trips.read_trip_csvs(spark, files)


def ingest_rejects(spark, d):
    """What ingest could not use of two damaged months, per month, from the trips table and
    the reject store that one ingest pass makes."""
    base = warehouse_path(spark, _own_name("damaged", d))
    dirs = []
    for month in ("2013-07", "2013-08"):
        path = csv_trips.join_path(base, month)
        lines = fixtures.render_damaged_lines(_trips(spark, d), month)
        lines.write.mode("overwrite").option("header", True).option("sep", "\u0001").csv(path)
        dirs.append(path)
    raw = csv_trips.read_raw_trip_csvs(spark, dirs)
    rows = ingest.split_rows(raw, csv_trips.MALFORMED, always=("source_file",))
    rows = rows.withColumn("month", csv_trips.feed_month("source_file"))
    kept, rejected = _own_name("damaged_trips", d), _own_name("damaged_rejects", d)
    trip_columns = [c for c in raw.columns if c != csv_trips.MALFORMED]
    outputs = {ingest.TRIPS: (kept, [*trip_columns, "month"]), ingest.REJECTS: (rejected, ["source_file", ingest.REASON, ingest.TEXT, "month"])}
    tables.save_outputs(rows, outputs, ["month"])
    return ingest.reject_counts(tables.read_table(spark, kept), tables.read_table(spark, rejected), "month")


def trips_table_roundtrip(spark, d):
    name = _own_name("trips", d)
    tables.save_table(_trips(spark, d), name)
    return tables.read_table(spark, name)


def trips_table_by_month(spark, d):
    """The trips saved as a table partitioned by start month, read back whole."""
    name = _own_name("trips_month", d)
    tables.save_table(calendar.with_start_month(_trips(spark, d)), name, partition_by=["start_month"])
    return tables.read_table(spark, name)


def trips_table_ddl(spark, d):
    """A saved table of other content is dropped by SQL and made anew."""
    name = _own_name("trips_ddl", d)
    tables.save_table(_trips(spark, d).select("trip_id"), name)
    tables.drop_table(spark, name)
    if spark.catalog.tableExists(name):
        raise RuntimeError(f"{name} is still there")
    tables.save_table(_trips(spark, d), name)
    return tables.read_table(spark, name)


# Reports over a trips table: the analysis itself, usable on any trips DataFrame.
ROW_SETS: dict[str, TripReport] = {f.__name__: f for f in (trips, trip_calendar, weekday_trips, weekend_trips, station_use_rows)}

# Aggregates of paths and stations: over trips or path facts.
ON_PATH_FACTS: dict[str, TripReport] = {
    f.__name__: f
    for f in (
        station_lookup, station_lookup_canonical, start_station_counts, end_station_counts, station_uses,
        undirected_path_counts, undirected_paths_top100, undirected_path_split, path_coords_top1000,
        path_coords_text_top1000, directed_paths_top1000, directed_paths_wkdy_am, directed_paths_wkdy_pm,
        directed_paths_wknd, directed_paths_by_period, project_stations, project_start_stations,
        project_end_stations, project_paths, stations_in_viewport, viewport_start_counts, path_kind, path_segments,
        project_path_coords, period_path_segments, period_scale_limit,
    )
}

# Aggregates of hours and days: over trips or time facts.
ON_TIME_FACTS: dict[str, TripReport] = {
    "hourly_start_weekday": hourly_start_weekday,
    "hourly_stop_weekday": hourly_stop_weekday,
    "hourly_start_weekend": hourly_start_weekend,
    "hourly_stop_weekend": hourly_stop_weekend,
    "hourly_usage": hourly_usage,
    "day_of_week_counts": day_of_week_counts,
}

ON_TRIPS: dict[str, TripReport] = {**ROW_SETS, **ON_PATH_FACTS, **ON_TIME_FACTS}


def _on_derived_trips(fn: TripReport) -> Report:
    return lambda spark, d: fn(_trips(spark, d))


REPORTS: dict[str, Report] = {
    **{name: _on_derived_trips(fn) for name, fn in ON_TRIPS.items()},
    "elapsed_lengths": elapsed_lengths,
    "ingest_mixed_timestamps": ingest_mixed_timestamps,
    "ingest_header_normalise": ingest_header_normalise,
    "ingest_header_variants": ingest_header_variants,
    "ingest_trips": ingest_trips,
    "ingest_time_rejects": ingest_time_rejects,
    "ingest_csv": ingest_csv,
    "ingest_rejects": ingest_rejects,
    "trips_table_roundtrip": trips_table_roundtrip,
    "trips_table_by_month": trips_table_by_month,
    "trips_table_ddl": trips_table_ddl,
}

FLAGSHIP = "path_coords_top1000"
