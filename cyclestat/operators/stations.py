"""Station tables: coordinate lookup, start / end / either-end counts.

Station-level results are bounded by the number of (name, coordinate)
variants, not by trips; the only wide step is the first, map-side-combined
aggregate over the trips scan.  Tables that look at both ends of a trip
read the scan once and emit the two ends with ``inline`` (one Generate, no
second scan, no union of two scans).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.plans.counting import TRIP_COUNT, count_trips

START_KEYS = [S.START_NAME, S.START_LON, S.START_LAT]
END_KEYS = [S.END_NAME, S.END_LON, S.END_LAT]
USE_KEYS = ["station_name", "station_longitude", "station_latitude"]


def _both_ends(trips: DataFrame, name: str, lon: str, lat: str, with_time: bool = False) -> DataFrame:
    """One row per trip end: (name, lon, lat[, use_time][, trip_count]) from a single scan."""
    def end(n, lo, la, t):
        fields = [F.col(n).alias(name), F.col(lo).alias(lon), F.col(la).alias(lat)]
        if with_time:
            fields.append(F.col(t).alias("use_time"))
        if TRIP_COUNT in trips.columns:
            fields.append(F.col(TRIP_COUNT))
        return F.struct(*fields)

    return trips.select(F.inline(F.array(
        end(S.START_NAME, S.START_LON, S.START_LAT, S.STARTTIME),
        end(S.END_NAME, S.END_LON, S.END_LAT, S.STOPTIME),
    )))


def station_lookup(trips: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct (name, longitude, latitude) over both trip ends.

    Columns keep the start-side names (``start_station_name``,
    ``start_station_longitude``, ``start_station_latitude``).  A station
    that moved or was re-surveyed has one row per coordinate, so joins on
    the name fan out; see :func:`station_lookup_canonical` for one row per name.
    """
    out = _both_ends(trips, *START_KEYS).select(*START_KEYS).distinct()
    return out.orderBy(*[F.col(c).asc_nulls_first() for c in START_KEYS]) if ordered else out


def with_coordinate_variants(lookup: DataFrame, name: str = S.START_NAME) -> DataFrame:
    """Add ``coordinate_variants``: how many coordinates the station name has
    in the lookup (more than 1 means joins on that name fan out).

    Being a window over the name, it also keeps later filters on derived
    coordinates (e.g. a projected viewport) on the small lookup: Catalyst
    pushes a predicate below a window only when it reads partition columns
    alone, so the projection is not moved below the distinct aggregate onto
    every trip end.
    """
    return lookup.withColumn("coordinate_variants", F.count(F.lit(1)).over(Window.partitionBy(name)))


def start_station_counts(trips: DataFrame) -> DataFrame:
    """Trips per start (name, longitude, latitude): ``count`` bigint."""
    return count_trips(trips, *START_KEYS)


def end_station_counts(trips: DataFrame) -> DataFrame:
    """Trips per end (name, longitude, latitude): ``count`` bigint."""
    return count_trips(trips, *END_KEYS)


def station_use_rows(trips: DataFrame) -> DataFrame:
    """One row per use: (name, longitude, latitude, ``use_time``), the start of
    a trip at its start station and its end at the other."""
    return _both_ends(trips, *USE_KEYS, with_time=True)


def station_uses(trips: DataFrame) -> DataFrame:
    """Uses (a trip starting or ending there) per (name, longitude, latitude)."""
    ends = _both_ends(trips, "station_name", "station_longitude", "station_latitude")
    return count_trips(ends, *USE_KEYS)


def station_lookup_canonical(trips: DataFrame) -> DataFrame:
    """One coordinate per station name: the most used, ties to the smallest
    (longitude, latitude).  Same columns as :func:`station_lookup`, plus
    ``uses`` of the chosen coordinate.  Joining on it never fans out.
    """
    uses = station_uses(trips)
    w = Window.partitionBy("station_name").orderBy(
        F.col("count").desc(), F.col("station_longitude").asc_nulls_first(),
        F.col("station_latitude").asc_nulls_first())
    return (uses.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select(F.col("station_name").alias(S.START_NAME),
                    F.col("station_longitude").alias(S.START_LON),
                    F.col("station_latitude").alias(S.START_LAT),
                    F.col("count").alias("uses")))
