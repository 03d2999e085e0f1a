"""Canonical column names, header spellings and other fixed values.

The trip feed arrives as monthly CSV files whose header spelling and
time layout changed over the years.  After ingest every trip table has the
canonical columns below; feed columns we never interpret stay strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

STARTTIME = "starttime"
STOPTIME = "stoptime"
START_NAME = "start_station_name"
START_LAT = "start_station_latitude"
START_LON = "start_station_longitude"
END_NAME = "end_station_name"
END_LAT = "end_station_latitude"
END_LON = "end_station_longitude"
USERTYPE = "usertype"

TIME_COLUMNS = (STARTTIME, STOPTIME)
COORDINATE_COLUMNS = (START_LAT, START_LON, END_LAT, END_LON)

# --- fixed values (must equal the feed's spellings) -------------------------
# Header spellings seen in the feed after "space -> _, lower case", mapped to
# the canonical name.  ``stopttime`` is a misspelling that appears in part of
# the historical data.
HEADER_ALIASES = {
    "start_time": "starttime",
    "stop_time": "stoptime",
    "stopttime": "stoptime",
    "trip_duration": "tripduration",
    "bike_id": "bikeid",
    "user_type": "usertype",
}
# Rider category that counts as a subscriber.
SUBSCRIBER = "Subscriber"
# Day labels indexed by Spark's dayofweek() (1 = Sunday .. 7 = Saturday).
DAY_LABELS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
# Separator between the two station names of an undirected path.
PATH_SEPARATOR = " - "
# Longest trip kept by the weekday/weekend tables, inclusive, in seconds.
MAX_TRIP_SECONDS = 60 * 60 * 24
# Start hours of the weekday rush periods.
MORNING_RUSH_HOURS = (8, 9)
EVENING_RUSH_HOURS = (17, 18)
# Result bounds of the published reports.
TOP_UNDIRECTED = 100
TOP_PATHS = 1000
MAP_PATHS = 150
POINTS_PER_PATH = 100
SCALE_STEP = 500
# -----------------------------------------------------------------------------

TRIP_SCHEMA = T.StructType(
    [
        T.StructField(STARTTIME, T.TimestampNTZType()),
        T.StructField(STOPTIME, T.TimestampNTZType()),
        T.StructField(START_NAME, T.StringType()),
        T.StructField(START_LAT, T.DoubleType()),
        T.StructField(START_LON, T.DoubleType()),
        T.StructField(END_NAME, T.StringType()),
        T.StructField(END_LAT, T.DoubleType()),
        T.StructField(END_LON, T.DoubleType()),
        T.StructField(USERTYPE, T.StringType()),
    ]
)


def canonical_name(raw: str) -> str:
    """Header text -> canonical column name (spaces to ``_``, lower case, aliases)."""
    norm = raw.replace(" ", "_").lower()
    return HEADER_ALIASES.get(norm, norm)
