"""DuckDB SQL equivalents of :mod:`cyclestat.reports`, for cross-engine checks.

Written independently of the Spark operators, against the raw ``events``
and ``nation`` tables.  Time fields are taken from wall-clock timestamps;
epoch seconds use integer microseconds so no rounding can move a second.
"""

from __future__ import annotations

from cyclestat.functions.geo import VIEWPORT_X, VIEWPORT_Y

TRIPS = """
trips AS (
  WITH e AS (
    SELECT event_id, user_id, ts, event_type,
           LEAST(CAST(FLOOR(value / 20) AS INTEGER), 24) AS k,
           CAST(event_id % 4 AS INTEGER) AS d
    FROM events),
  p AS (
    SELECT *, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS ts2,
              LEAD(k)  OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS k2,
              LEAD(d)  OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS d2
    FROM e)
  SELECT p.event_id AS trip_id, p.ts AS starttime,
    CASE WHEN event_id % 71 = 19 THEN NULL WHEN event_id % 79 = 13 THEN ts - INTERVAL 1 MINUTE
         WHEN event_id % 73 = 17 THEN ts + INTERVAL 24 HOUR ELSE ts2 END AS stoptime,
    CASE WHEN event_id % 97 = 5 THEN NULL ELSE CASE WHEN event_id % 83 = 11 THEN 'Pier - ' ELSE '' END
         || s.n_name || ' dock ' || CAST(d AS VARCHAR) END AS start_station_name,
    CAST(407000 + 80*k + 10*d + CASE WHEN k % 10 = 0 AND ts >= TIMESTAMP '2024-01-16 00:00:00'
         THEN 1 ELSE 0 END AS DOUBLE) / 10000 AS start_station_latitude,
    CAST(-740100 + 30*k - 10*d AS DOUBLE) / 10000 AS start_station_longitude,
    CASE WHEN event_id % 101 = 7 THEN NULL ELSE x.n_name || ' dock ' || CAST(d2 AS VARCHAR) END AS end_station_name,
    CAST(407000 + 80*k2 + 10*d2 + CASE WHEN k2 % 10 = 0 AND ts2 >= TIMESTAMP '2024-01-16 00:00:00'
         THEN 1 ELSE 0 END AS DOUBLE) / 10000 AS end_station_latitude,
    CAST(-740100 + 30*k2 - 10*d2 AS DOUBLE) / 10000 AS end_station_longitude,
    CASE WHEN event_id % 89 = 7 THEN NULL WHEN p.event_type IN ('purchase', 'signup') THEN 'Subscriber'
         ELSE 'Customer' END AS usertype
  FROM p JOIN nation s ON s.n_nationkey = p.k
         JOIN nation x ON x.n_nationkey = p.k2
  WHERE ts2 IS NOT NULL)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((TRIPS, *ctes)) + "\n"


def _secs(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000000)"


LENGTH = f"({_secs('stoptime')} - {_secs('starttime')})"
WEEKDAY = (f"{LENGTH} <= 86400 AND dayofweek(starttime) NOT IN (0, 6) "
           f"AND dayofweek(stoptime) NOT IN (0, 6)")
WEEKEND = (f"{LENGTH} <= 86400 AND dayofweek(starttime) IN (0, 6) "
           f"AND dayofweek(stoptime) IN (0, 6)")
CALENDAR = f"""calendar AS (
  SELECT *, strftime(starttime, '%a') AS start_dayofweek, strftime(stoptime, '%a') AS stop_dayofweek,
         {_secs('starttime')} AS starttime_unix, {_secs('stoptime')} AS stoptime_unix,
         {_secs('stoptime')} - {_secs('starttime')} AS trip_length_sec
  FROM trips)"""

DKEYS = ("start_station_name, start_station_latitude, start_station_longitude, "
         "end_station_name, end_station_latitude, end_station_longitude")
DORDER = ("count DESC, start_station_name NULLS FIRST, start_station_latitude NULLS FIRST, "
          "start_station_longitude NULLS FIRST, end_station_name NULLS FIRST, "
          "end_station_latitude NULLS FIRST, end_station_longitude NULLS FIRST")
PAIR = ("CASE WHEN start_station_name < end_station_name THEN start_station_name ELSE end_station_name END"
        " || ' - ' || "
        "CASE WHEN start_station_name < end_station_name THEN end_station_name ELSE start_station_name END")
S1 = ("CASE WHEN start_station_name < end_station_name THEN start_station_name ELSE end_station_name END")
S2 = ("CASE WHEN start_station_name < end_station_name THEN end_station_name ELSE start_station_name END")
PAIRS = f"""pairs AS (
  SELECT {S1} AS station_1, {S2} AS station_2, COUNT(*) AS count
  FROM trips WHERE start_station_name IS NOT NULL AND end_station_name IS NOT NULL
  GROUP BY 1, 2)"""
UNDIRECTED = f"""undirected AS (
  SELECT station_names, COUNT(*) AS count, AVG(is_subscriber) AS pct_subscriber
  FROM (SELECT {PAIR} AS station_names,
               CASE WHEN usertype = 'Subscriber' THEN 1 ELSE 0 END AS is_subscriber FROM trips)
  GROUP BY station_names)"""
LOOKUP = """lut AS (
  SELECT start_station_name, start_station_longitude, start_station_latitude FROM trips
  UNION
  SELECT end_station_name, end_station_longitude, end_station_latitude FROM trips)"""
USES = """uses AS (
  SELECT station_name, station_longitude, station_latitude, COUNT(*) AS count FROM (
    SELECT start_station_name AS station_name, start_station_longitude AS station_longitude,
           start_station_latitude AS station_latitude FROM trips
    UNION ALL
    SELECT end_station_name, end_station_longitude, end_station_latitude FROM trips)
  GROUP BY ALL)"""
PERIOD = f"""CASE WHEN {WEEKDAY} AND hour(starttime) IN (8, 9) THEN 'wkdy_am'
              WHEN {WEEKDAY} AND hour(starttime) IN (17, 18) THEN 'wkdy_pm'
              WHEN {WEEKEND} THEN 'wknd' END"""
PERIOD_COUNTS = f"""period_counts AS (
  SELECT period, {DKEYS}, COUNT(*) AS count
  FROM (SELECT {PERIOD} AS period, * FROM trips) WHERE period IS NOT NULL
  GROUP BY ALL)"""


def _lit(v: float) -> str:
    r = repr(float(v))
    return r if "e" in r or "inf" in r or "nan" in r else r + "e0"


# The coordinate system's published parameters (fixed values); all else is SQL.
_A, _INVERSE_F, _FOOT = "6378137.0e0", "298.257222101e0", "0.3048006096012192e0"
_PAR1, _PAR2, _LAT0, _LON0 = "40.66666666666666e0", "41.03333333333333e0", "40.16666666666666e0", "-74.0e0"
_EAST, _NORTH = "984250.0e0", "0.0e0"
_E2 = f"(2 / {_INVERSE_F} - pow(1 / {_INVERSE_F}, 2))"
_E = f"sqrt({_E2})"


def _m(lat: str) -> str:
    return f"(cos(radians({lat})) / sqrt(1 - {_E2} * pow(sin(radians({lat})), 2)))"


def _t(lat: str) -> str:
    es = f"{_E} * sin(radians({lat}))"
    return f"(tan(radians(45.0e0 - ({lat}) / 2)) / pow((1 - {es}) / (1 + {es}), {_E} / 2))"


_N = f"((ln({_m(_PAR1)}) - ln({_m(_PAR2)})) / (ln({_t(_PAR1)}) - ln({_t(_PAR2)})))"
_AF = f"({_A} / {_FOOT} * {_m(_PAR1)} / ({_N} * pow({_t(_PAR1)}, {_N})))"


def project_sql(lon: str, lat: str) -> tuple[str, str]:
    """(x, y) SQL expressions of the Lambert conformal conic formula."""
    rho = f"({_AF} * pow({_t(lat)}, {_N}))"
    rho0 = f"({_AF} * pow({_t(_LAT0)}, {_N}))"
    theta = f"({_N} * radians({lon} - ({_LON0})))"
    return f"({rho} * sin({theta}) + {_EAST})", f"({rho0} - {rho} * cos({theta}) + {_NORTH})"


def _hourly(ts: str, name: str, pred: str) -> str:
    return _with() + (f"SELECT CAST(hour({ts}) AS INTEGER) AS {name}, COUNT(*) AS count "
                      f"FROM trips WHERE {pred} GROUP BY 1 ORDER BY 1")


def _directed_top(pred: str | None) -> str:
    where = f"WHERE {pred}" if pred else ""
    return _with() + (f"SELECT {DKEYS}, COUNT(*) AS count FROM trips {where} "
                      f"GROUP BY ALL ORDER BY {DORDER} LIMIT 1000")


def _ingest_select(time_fn: str, month: str, with_text_id: bool = True) -> str:
    return (f"SELECT {time_fn.format('starttime')} AS starttime, {time_fn.format('stoptime')} AS stoptime, "
            "start_station_name, start_station_latitude, start_station_longitude, "
            "end_station_name, end_station_latitude, end_station_longitude, "
            f"CAST(trip_id AS VARCHAR) AS bikeid, usertype, '{month}' AS source_month FROM trips")


SEC = "date_trunc('second', {})"
MIN = "date_trunc('minute', {})"
INGEST_ALL = " UNION ALL ".join([_ingest_select(SEC, "2013-07"), _ingest_select(MIN, "2015-01"),
                                 _ingest_select(SEC, "2016-10")])

_SX, _SY = project_sql("start_station_longitude", "start_station_latitude")
_EX, _EY = project_sql("end_station_longitude", "end_station_latitude")
_UX, _UY = project_sql("station_longitude", "station_latitude")
_NX, _NY = project_sql("end_station_longitude", "end_station_latitude")
_LX, _LY = project_sql("start_station_longitude", "start_station_latitude")
_P1X, _P1Y = project_sql("lon_1", "lat_1")
_P2X, _P2Y = project_sql("lon_2", "lat_2")

SQL: dict[str, str] = {
    "trips": _with() + "SELECT * FROM trips",
    "trip_calendar": _with(CALENDAR) + "SELECT * FROM calendar",
    "weekday_trips": _with(CALENDAR) + f"SELECT * FROM calendar WHERE {WEEKDAY}",
    "weekend_trips": _with(CALENDAR) + f"SELECT * FROM calendar WHERE {WEEKEND}",
    "station_lookup": _with(LOOKUP) + "SELECT * FROM lut ORDER BY 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST",
    "station_lookup_canonical": _with(USES) + """
      SELECT station_name AS start_station_name, station_longitude AS start_station_longitude,
             station_latitude AS start_station_latitude, count AS uses
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_name
                    ORDER BY count DESC, station_longitude NULLS FIRST, station_latitude NULLS FIRST) AS rn
            FROM uses) WHERE rn = 1 ORDER BY 1""",
    "start_station_counts": _with() + """
      SELECT start_station_name, start_station_longitude, start_station_latitude, COUNT(*) AS count
      FROM trips GROUP BY ALL ORDER BY count DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST""",
    "end_station_counts": _with() + """
      SELECT end_station_name, end_station_longitude, end_station_latitude, COUNT(*) AS count
      FROM trips GROUP BY ALL ORDER BY count DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST""",
    "station_uses": _with(USES) + "SELECT * FROM uses ORDER BY count DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST",
    "hourly_start_weekday": _hourly("starttime", "start_hour", WEEKDAY),
    "hourly_stop_weekday": _hourly("stoptime", "stop_hour", WEEKDAY),
    "hourly_start_weekend": _hourly("starttime", "start_hour", WEEKEND),
    "hourly_stop_weekend": _hourly("stoptime", "stop_hour", WEEKEND),
    "hourly_usage": _with(f"""typed AS (
        SELECT CASE WHEN {WEEKDAY} THEN 'weekday' WHEN {WEEKEND} THEN 'weekend' END AS day_type,
               starttime, stoptime FROM trips)""") + """
      SELECT day_type, series, hour, COUNT(*) AS count FROM (
        SELECT day_type, 'Start' AS series, CAST(hour(starttime) AS INTEGER) AS hour FROM typed
        UNION ALL
        SELECT day_type, 'Stop', CAST(hour(stoptime) AS INTEGER) FROM typed)
      WHERE day_type IS NOT NULL GROUP BY ALL ORDER BY 1, 2, 3""",
    "day_of_week_counts": _with() + """
      SELECT strftime(starttime, '%a') AS day_of_week, COUNT(*) AS count,
             CAST(dayofweek(starttime) + 1 AS INTEGER) AS ordinal_number
      FROM trips GROUP BY ALL ORDER BY ordinal_number""",
    "undirected_path_counts": _with(UNDIRECTED) + "SELECT * FROM undirected ORDER BY count DESC, station_names NULLS FIRST",
    "undirected_paths_top100": _with(UNDIRECTED) + """
      SELECT * FROM undirected ORDER BY count DESC, station_names NULLS FIRST LIMIT 100""",
    "undirected_path_split": _with(UNDIRECTED) + """
      SELECT count, split_part(station_names, ' - ', 1) AS station_1,
             split_part(station_names, ' - ', 2) AS station_2 FROM undirected""",
    "path_coords_top1000": _with(PAIRS, LOOKUP) + """
      SELECT p.station_1, p.station_2, p.count,
             a.start_station_latitude AS lat_1, a.start_station_longitude AS lon_1,
             b.start_station_longitude AS lon_2, b.start_station_latitude AS lat_2
      FROM pairs p
      JOIN lut a ON p.station_1 = a.start_station_name
      JOIN lut b ON p.station_2 = b.start_station_name
      ORDER BY count DESC, station_1 NULLS FIRST, station_2 NULLS FIRST, lat_1 NULLS FIRST,
               lon_1 NULLS FIRST, lon_2 NULLS FIRST, lat_2 NULLS FIRST
      LIMIT 1000""",
    "path_coords_text_top1000": _with(UNDIRECTED, LOOKUP, """split AS (
      SELECT count, split_part(station_names, ' - ', 1) AS station_1,
             split_part(station_names, ' - ', 2) AS station_2 FROM undirected)""") + """
      SELECT p.station_1, p.station_2, p.count,
             a.start_station_latitude AS lat_1, a.start_station_longitude AS lon_1,
             b.start_station_longitude AS lon_2, b.start_station_latitude AS lat_2
      FROM split p
      JOIN lut a ON p.station_1 = a.start_station_name
      JOIN lut b ON p.station_2 = b.start_station_name
      ORDER BY count DESC, station_1 NULLS FIRST, station_2 NULLS FIRST, lat_1 NULLS FIRST,
               lon_1 NULLS FIRST, lon_2 NULLS FIRST, lat_2 NULLS FIRST
      LIMIT 1000""",
    "directed_paths_top1000": _directed_top(None),
    "directed_paths_wkdy_am": _directed_top(f"{WEEKDAY} AND hour(starttime) IN (8, 9)"),
    "directed_paths_wkdy_pm": _directed_top(f"{WEEKDAY} AND hour(starttime) IN (17, 18)"),
    "directed_paths_wknd": _directed_top(WEEKEND),
    "directed_paths_by_period": _with(PERIOD_COUNTS) + f"""
      SELECT * FROM (
        SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY period ORDER BY {DORDER}) AS INTEGER) AS rank
        FROM period_counts) WHERE rank <= 150""",
    "project_stations": _with(USES) + f"""
      SELECT *, round({_UX}, 3) AS x_ft, round({_UY}, 3) AS y_ft FROM uses""",
    "station_use_rows": _with() + """
      SELECT start_station_name AS station_name, start_station_longitude AS station_longitude,
             start_station_latitude AS station_latitude, starttime AS use_time FROM trips
      UNION ALL
      SELECT end_station_name, end_station_longitude, end_station_latitude, stoptime FROM trips""",
    "project_start_stations": _with() + f"""
      SELECT start_station_name, start_station_longitude, start_station_latitude, COUNT(*) AS count,
             round({_LX}, 3) AS x_ft, round({_LY}, 3) AS y_ft FROM trips GROUP BY ALL""",
    "project_end_stations": _with() + f"""
      SELECT end_station_name, end_station_longitude, end_station_latitude, COUNT(*) AS count,
             round({_NX}, 3) AS x_ft, round({_NY}, 3) AS y_ft FROM trips GROUP BY ALL""",
    "project_paths": _with(f"""top AS (SELECT {DKEYS}, COUNT(*) AS count FROM trips
                                GROUP BY ALL ORDER BY {DORDER} LIMIT 1000)""") + f"""
      SELECT *, round({_SX}, 3) AS start_x_ft, round({_SY}, 3) AS start_y_ft,
             round({_EX}, 3) AS end_x_ft, round({_EY}, 3) AS end_y_ft FROM top""",
    "stations_in_viewport": _with(LOOKUP, f"""proj AS (
        SELECT *, {_LX} AS x_ft, {_LY} AS y_ft,
               COUNT(*) OVER (PARTITION BY start_station_name) AS coordinate_variants FROM lut)""") + f"""
      SELECT start_station_name, start_station_longitude, start_station_latitude, coordinate_variants,
             round(x_ft, 3) AS x_ft, round(y_ft, 3) AS y_ft FROM proj
      WHERE x_ft BETWEEN {_lit(VIEWPORT_X[0])} AND {_lit(VIEWPORT_X[1])}
        AND y_ft BETWEEN {_lit(VIEWPORT_Y[0])} AND {_lit(VIEWPORT_Y[1])}""",
    "viewport_start_counts": _with(f"""inside AS (
        SELECT * FROM trips WHERE {_SX} BETWEEN {_lit(VIEWPORT_X[0])} AND {_lit(VIEWPORT_X[1])}
          AND {_SY} BETWEEN {_lit(VIEWPORT_Y[0])} AND {_lit(VIEWPORT_Y[1])})""") + """
      SELECT start_station_name, start_station_longitude, start_station_latitude, COUNT(*) AS count
      FROM inside GROUP BY ALL""",
    # Clocks in New York are four hours behind UTC from the spring to the autumn change, else five; a
    # time shown twice counts as the first showing, a skipped one by the clock from before.
    "elapsed_lengths": _with(f"""lengths AS (
        SELECT trip_id, {_secs('starttime')} % 172800 AS sec, {LENGTH} AS wall_sec FROM trips), moved AS (
        SELECT trip_id, wall_sec, CASE WHEN trip_id % 2 = 0 THEN TIMESTAMP '2024-03-09 00:00:00'
               ELSE TIMESTAMP '2024-11-02 00:00:00' END + to_seconds(sec) AS starttime
        FROM lengths WHERE wall_sec BETWEEN 0 AND 172800), ends AS (
        SELECT *, starttime + to_seconds(wall_sec) AS stoptime FROM moved), behind AS (
        SELECT *, CASE WHEN starttime >= TIMESTAMP '2024-03-10 03:00:00' AND starttime < TIMESTAMP '2024-11-03 02:00:00' THEN 4 ELSE 5 END AS h1,
               CASE WHEN stoptime >= TIMESTAMP '2024-03-10 03:00:00' AND stoptime < TIMESTAMP '2024-11-03 02:00:00' THEN 4 ELSE 5 END AS h2
        FROM ends)""") + """
      SELECT trip_id, starttime, stoptime, wall_sec, wall_sec + 3600 * (h2 - h1) AS elapsed_sec FROM behind""",
    "path_kind": _directed_top(None).replace(
        f"SELECT {DKEYS}, COUNT(*) AS count FROM trips",
        f"SELECT {DKEYS}, COUNT(*) AS count, CASE WHEN start_station_name = end_station_name THEN 'loop' "
        "WHEN start_station_name <> end_station_name THEN 'segment' END AS path_kind FROM trips"),
    "path_segments": _with(f"""ranked AS (
        SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY {DORDER}) AS INTEGER) AS path_rank
        FROM (SELECT {DKEYS}, COUNT(*) AS count FROM trips GROUP BY ALL)
        QUALIFY path_rank <= 150)""", f"""proj AS (
        SELECT path_rank, count, start_station_name = end_station_name AS is_loop,
               {_SX} AS sx, {_SY} AS sy, {_EX} AS ex, {_EY} AS ey FROM ranked)""") + """
      SELECT path_rank, CAST(position AS INTEGER) AS position,
             round(CASE WHEN position = 100 THEN ex ELSE sx + (position - 1) * ((ex - sx) / 99) END, 3) AS x_ft,
             round(CASE WHEN position = 100 THEN ey ELSE sy + (position - 1) * ((ey - sy) / 99) END, 3) AS y_ft,
             count
      FROM proj, LATERAL (SELECT generate_series AS position
                          FROM generate_series(1, CASE WHEN is_loop THEN 1 ELSE 100 END))
      ORDER BY path_rank, position""",
    "project_path_coords": _with(PAIRS, LOOKUP, """top AS (
      SELECT p.station_1, p.station_2, p.count,
             a.start_station_latitude AS lat_1, a.start_station_longitude AS lon_1,
             b.start_station_longitude AS lon_2, b.start_station_latitude AS lat_2
      FROM pairs p
      JOIN lut a ON p.station_1 = a.start_station_name
      JOIN lut b ON p.station_2 = b.start_station_name
      ORDER BY count DESC, station_1 NULLS FIRST, station_2 NULLS FIRST, lat_1 NULLS FIRST,
               lon_1 NULLS FIRST, lon_2 NULLS FIRST, lat_2 NULLS FIRST
      LIMIT 100)""") + f"""
      SELECT *, round({_P1X}, 3) AS x_1_ft, round({_P1Y}, 3) AS y_1_ft,
             round({_P2X}, 3) AS x_2_ft, round({_P2Y}, 3) AS y_2_ft,
             CASE WHEN station_1 = station_2 THEN 'loop' WHEN station_1 <> station_2 THEN 'segment' END
               AS path_kind
      FROM top""",
    "period_path_segments": _with(PERIOD_COUNTS, f"""ranked AS (
        SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY period ORDER BY {DORDER}) AS INTEGER) AS rank
        FROM period_counts QUALIFY rank <= 150)""", f"""proj AS (
        SELECT period, rank, count, start_station_name = end_station_name AS is_loop,
               {_SX} AS sx, {_SY} AS sy, {_EX} AS ex, {_EY} AS ey FROM ranked)""") + """
      SELECT period, rank, CAST(position AS INTEGER) AS position,
             round(CASE WHEN position = 100 THEN ex ELSE sx + (position - 1) * ((ex - sx) / 99) END, 3) AS x_ft,
             round(CASE WHEN position = 100 THEN ey ELSE sy + (position - 1) * ((ey - sy) / 99) END, 3) AS y_ft,
             count
      FROM proj, LATERAL (SELECT generate_series AS position
                          FROM generate_series(1, CASE WHEN is_loop THEN 1 ELSE 100 END))""",
    "period_scale_limit": _with(PERIOD_COUNTS) + """
      SELECT MAX(count) AS max_count, CAST(CEIL(MAX(count) / 500) * 500 AS BIGINT) AS max_limit
      FROM period_counts""",
    "ingest_mixed_timestamps": _with() + """
      SELECT trip_id, 'iso' AS layout, date_trunc('second', starttime) AS starttime,
             date_trunc('second', stoptime) AS stoptime FROM trips
      UNION ALL
      SELECT trip_id, 'us', date_trunc('second', starttime), date_trunc('second', stoptime) FROM trips
      UNION ALL
      SELECT trip_id, 'us_short', date_trunc('minute', starttime), date_trunc('minute', stoptime) FROM trips""",
    "ingest_header_normalise": _with() + """
      SELECT strftime(starttime, '%m/%d/%Y %H:%M:%S') AS starttime,
             strftime(stoptime, '%m/%d/%Y %H:%M:%S') AS stoptime,
             start_station_name, CAST(start_station_latitude AS VARCHAR) AS start_station_latitude,
             CAST(start_station_longitude AS VARCHAR) AS start_station_longitude,
             end_station_name, CAST(end_station_latitude AS VARCHAR) AS end_station_latitude,
             CAST(end_station_longitude AS VARCHAR) AS end_station_longitude,
             CAST(trip_id AS VARCHAR) AS bikeid, usertype, '2016-10' AS source_month
      FROM trips""",
    "ingest_header_variants": _with() + _ingest_select(SEC, "2013-07") + " UNION ALL "
    + _ingest_select(SEC, "2016-10"),
    "ingest_trips": _with() + INGEST_ALL,
    "ingest_time_rejects": _with() + """
      SELECT m.source_month, COUNT(*) AS rows,
             CAST(SUM(CASE WHEN m.bad OR m.day_first AND day(starttime) > 12 THEN 1 ELSE 0 END) AS BIGINT) AS bad_starttime,
             CAST(SUM(CASE WHEN m.day_first AND day(stoptime) > 12 THEN 1 ELSE 0 END) AS BIGINT) AS bad_stoptime
      FROM trips, (VALUES ('2013-07', false, false), ('2015-01', false, false), ('2016-10', false, false),
                          ('2015-06', true, false), ('2015-07', false, true)) m(source_month, day_first, bad)
      GROUP BY 1 ORDER BY 1""",
    "ingest_rejects": _with("""damage AS (
        SELECT CASE WHEN trip_id % 53 = 3 OR trip_id % 59 = 4 THEN 'cells' WHEN trip_id % 61 = 6 THEN 'time'
                    WHEN trip_id % 67 = 8 THEN 'coordinate' END AS kind FROM trips)""") + """
      SELECT month, COUNT(*) AS rows, COUNT(*) FILTER (kind = 'cells') AS malformed,
             COUNT(*) FILTER (kind = 'time') AS bad_starttime, 0::BIGINT AS bad_stoptime,
             COUNT(*) FILTER (kind = 'coordinate') AS bad_start_station_latitude,
             0::BIGINT AS bad_start_station_longitude, 0::BIGINT AS bad_end_station_latitude,
             0::BIGINT AS bad_end_station_longitude
      FROM damage, (VALUES ('2013-07'), ('2013-08')) m(month) GROUP BY month""",
    "ingest_csv": _with() + INGEST_ALL,
    "trips_table_roundtrip": _with() + "SELECT * FROM trips",
    "trips_table_ddl": _with() + "SELECT * FROM trips",
    "trips_table_by_month": _with() + "SELECT *, strftime(starttime, '%Y-%m') AS start_month FROM trips",
}
