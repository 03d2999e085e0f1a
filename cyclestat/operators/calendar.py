"""Trip calendar columns and the weekday / weekend trip sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.functions.calendar import (
    day_label,
    epoch_seconds,
    epoch_seconds_in,
    is_weekday_trip,
    is_weekend_trip,
)


def with_trip_calendar(trips: DataFrame, zone: str | None = None) -> DataFrame:
    """Add ``start_dayofweek``/``stop_dayofweek`` (``Sun``..``Sat``),
    ``starttime_unix``/``stoptime_unix`` (whole seconds) and
    ``trip_length_sec`` (their difference): of the wall clock, or of clocks in ``zone``
    (:func:`cyclestat.functions.calendar.trip_length_seconds`)."""
    seconds = (lambda c: epoch_seconds_in(c, zone)) if zone else epoch_seconds
    return trips.withColumns({
        "start_dayofweek": day_label(S.STARTTIME),
        "stop_dayofweek": day_label(S.STOPTIME),
        "starttime_unix": seconds(S.STARTTIME),
        "stoptime_unix": seconds(S.STOPTIME),
    }).withColumn("trip_length_sec", F.col("stoptime_unix") - F.col("starttime_unix"))


def with_start_month(trips: DataFrame, name: str = "start_month") -> DataFrame:
    """Add the start month as ``yyyy-MM`` text (a partition column for the
    trips table); built from calendar fields, so zone-free."""
    # concat/lpad rather than format_string: no java.util.Formatter per row
    month = F.concat(F.lpad(F.year(S.STARTTIME).cast("string"), 4, "0"), F.lit("-"),
                     F.lpad(F.month(S.STARTTIME).cast("string"), 2, "0"))
    return trips.withColumn(name, month)


def weekday_trips(trips: DataFrame, max_seconds: int = S.MAX_TRIP_SECONDS, zone: str | None = None) -> DataFrame:
    """Trips of at most ``max_seconds`` (inclusive) starting and ending Mon-Fri,
    with the calendar columns."""
    return with_trip_calendar(trips, zone).where(is_weekday_trip(max_seconds=max_seconds, zone=zone))


def weekend_trips(trips: DataFrame, max_seconds: int = S.MAX_TRIP_SECONDS, zone: str | None = None) -> DataFrame:
    """Trips of at most ``max_seconds`` (inclusive) starting and ending Sat/Sun,
    with the calendar columns."""
    return with_trip_calendar(trips, zone).where(is_weekend_trip(max_seconds=max_seconds, zone=zone))
