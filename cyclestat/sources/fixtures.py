"""Trip-shaped data derived from the driver's generic tables.

No trip feed ships with the test data, so trips are successive events of
one user in ``events``; station names come from ``nation``.  The rule, in
words:

* bucket ``k = least(floor(value / 20), 24)`` (skewed on purpose), dock
  ``d = event_id % 4``;
* order each user's events by ``(ts, event_id)``; an event starts a trip that
  ends at the user's next event; a user's last event starts none;
* station name = ``<nation name of k> dock <d>``; latitude
  ``(407000 + 80k + 10d + moved) / 10000``, longitude
  ``(-740100 + 30k - 10d) / 10000``, where ``moved`` is 1 for ``k % 10 = 0``
  from 2024-01-16 on (one name, two coordinates: exercises join fan-out);
* rider ``Subscriber`` for ``purchase``/``signup`` events, else ``Customer``;
* then, by ``event_id`` modulo fixed numbers (``DEFECTS``), some trips lose a
  name, the rider or the stop time, get a start name that holds the path
  separator, a stop a minute before the start, or a length of exactly 24 h.

The derivation is a plan and nothing else: no job runs and nothing is written
when it is made.  It grows with ``events``; the "next event" step uses
:func:`cyclestat.operators.sequence.with_next`, which stays balanced when one
user holds a large share of all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.functions.timeparse import render_trip_time
from cyclestat.operators.sequence import with_next
from cyclestat.sources.csv_trips import join_path

# --- fixed values of the fixture rule ----------------------------------------
BUCKET_WIDTH = 20
MAX_BUCKET = 24
DOCKS = 4
LAT_BASE, LAT_BUCKET, LAT_DOCK = 407000, 80, 10
LON_BASE, LON_BUCKET, LON_DOCK = -740100, 30, -10
COORD_SCALE = 10000.0
MOVE_EVERY = 10
MOVE_FROM = "2024-01-16 00:00:00"
SUBSCRIBER_EVENTS = ("purchase", "signup")
# Trips with hard values: ``event_id % modulus == rest``.
DEFECTS = {
    "no_start_name": (97, 5), "no_end_name": (101, 7), "separator": (83, 11), "no_rider": (89, 7),
    "backwards": (79, 13), "whole_day": (73, 17), "no_stop": (71, 19),
}
SEPARATED_PREFIX = "Pier - "
# -----------------------------------------------------------------------------

TRIP_COLUMNS = ["trip_id", *[f.name for f in S.TRIP_SCHEMA.fields]]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(join_path(sf_dir, f"{name}.parquet"))


def _lat(k, d, ts):
    moved = F.when((k % MOVE_EVERY == 0) & (ts >= F.lit(MOVE_FROM).cast("timestamp_ntz")), 1).otherwise(0)
    return (F.lit(LAT_BASE) + LAT_BUCKET * k + LAT_DOCK * d + moved).cast("double") / COORD_SCALE


def _lon(k, d):
    return (F.lit(LON_BASE) + LON_BUCKET * k + LON_DOCK * d).cast("double") / COORD_SCALE


def _has(defect: str):
    modulus, rest = DEFECTS[defect]
    return F.col("event_id") % modulus == rest


def events_to_trips(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Trips (``trip_id`` + the canonical trip columns) from events and nations."""
    e = events.select(
        "event_id", "user_id", "ts", "event_type",
        F.least(F.floor(F.col("value") / BUCKET_WIDTH).cast("int"), F.lit(MAX_BUCKET)).alias("k"),
        (F.col("event_id") % DOCKS).cast("int").alias("d"),
    )
    p = with_next(e, "user_id", ["ts", "event_id"], ["ts", "k", "d"], chunk=F.to_date("ts")) \
        .where(F.col("next_ts").isNotNull())
    names = nation.select("n_nationkey", "n_name")
    s = names.select(F.col("n_nationkey").alias("_sk"), F.col("n_name").alias("_sn"))
    x = names.select(F.col("n_nationkey").alias("_xk"), F.col("n_name").alias("_xn"))
    j = p.join(s, F.col("k") == F.col("_sk")).join(x, F.col("next_k") == F.col("_xk"))
    k, d, ts = F.col("k"), F.col("d"), F.col("ts")
    k2, d2, ts2 = F.col("next_k"), F.col("next_d"), F.col("next_ts")
    start_name = F.concat(F.col("_sn"), F.lit(" dock "), d.cast("string"))
    start_name = F.when(_has("separator"), F.concat(F.lit(SEPARATED_PREFIX), start_name)).otherwise(start_name)
    end_name = F.concat(F.col("_xn"), F.lit(" dock "), d2.cast("string"))
    rider = F.when(F.col("event_type").isin(*SUBSCRIBER_EVENTS), F.lit(S.SUBSCRIBER)).otherwise(F.lit("Customer"))
    stop = (F.when(_has("no_stop"), F.lit(None)).when(_has("backwards"), ts - F.expr("INTERVAL 1 MINUTE"))
            .when(_has("whole_day"), ts + F.expr("INTERVAL 24 HOURS")).otherwise(ts2))
    return j.select(
        F.col("event_id").alias("trip_id"),
        ts.alias(S.STARTTIME),
        stop.alias(S.STOPTIME),
        F.when(~_has("no_start_name"), start_name).alias(S.START_NAME),
        _lat(k, d, ts).alias(S.START_LAT),
        _lon(k, d).alias(S.START_LON),
        F.when(~_has("no_end_name"), end_name).alias(S.END_NAME),
        _lat(k2, d2, ts2).alias(S.END_LAT),
        _lon(k2, d2).alias(S.END_LON),
        F.when(~_has("no_rider"), rider).alias(S.USERTYPE),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips plan over ``events`` and ``nation``."""
    return events_to_trips(read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "nation"))


# --- raw feed rendering -------------------------------------------------------
# Header spellings of the two feed generations, in feed column order.
CLASSIC_HEADER = ["starttime", "stoptime", "start station name", "start station latitude",
                  "start station longitude", "end station name", "end station latitude",
                  "end station longitude", "bikeid", "usertype", "source month"]
TITLED_HEADER = ["Start Time", "Stop Time", "Start Station Name", "Start Station Latitude",
                 "Start Station Longitude", "End Station Name", "End Station Latitude",
                 "End Station Longitude", "Bike ID", "User Type", "Source Month"]
HEADERS = {"classic": CLASSIC_HEADER, "titled": TITLED_HEADER}


def render_raw_feed(trips_df: DataFrame, header: str, layout: str, month: str) -> DataFrame:
    """Trips as one month of the raw feed: every value a string, times in
    ``layout``, columns named by the ``header`` generation; ``bikeid`` carries
    the trip id and ``source month`` the given month tag."""
    values = [
        render_trip_time(S.STARTTIME, layout), render_trip_time(S.STOPTIME, layout),
        F.col(S.START_NAME), F.col(S.START_LAT).cast("string"), F.col(S.START_LON).cast("string"),
        F.col(S.END_NAME), F.col(S.END_LAT).cast("string"), F.col(S.END_LON).cast("string"),
        F.col("trip_id").cast("string"), F.col(S.USERTYPE), F.lit(month),
    ]
    return trips_df.select(*[v.alias(h) for v, h in zip(values, HEADERS[header])])


def render_day_first_feed(trips_df: DataFrame, month: str) -> DataFrame:
    """A month of the feed written day-first (``dd/MM/yyyy HH:mm:ss``) by
    mistake: days above 12 make impossible US dates (rejects), the others
    parse to a wrong but valid date, as a US reader would see them."""
    return render_raw_feed(trips_df, "classic", "day_first", month)


# Three feed generations: (month tag, header, time layout).
FEED_GENERATIONS = (
    ("2013-07", "classic", "iso"),
    ("2015-01", "classic", "us_short"),
    ("2016-10", "titled", "us"),
)


# Start times that are no time, each close to a feed layout.
MALFORMED_TIMES = ("1/2/3/2015 10:00", "01/02/2015 garbage 10:00", "1/2/2015 09:00 10:00", "2013-07-01 00:00:00.oops")
# Lines of a damaged feed: ``trip_id % modulus == rest``, the first that holds.
DAMAGE = {"short": (53, 3), "long": (59, 4), "time": (61, 6), "coordinate": (67, 8)}
SHORT_CELLS = 5


def render_malformed_times(trips_df: DataFrame, month: str) -> DataFrame:
    """A month whose start times are all malformed, in four ways by trip id."""
    raw = render_raw_feed(trips_df, "classic", "iso", month)
    at = (F.col("bikeid").cast("bigint") % len(MALFORMED_TIMES) + 1).cast("int")
    return raw.withColumn(CLASSIC_HEADER[0], F.element_at(F.array(*map(F.lit, MALFORMED_TIMES)), at))


def render_damaged_lines(trips_df: DataFrame, month: str) -> DataFrame:
    """One column, named as the header line, of CSV lines: some cut short, some with a
    cell too many, some with a malformed start time or start latitude."""
    raw = render_raw_feed(trips_df, "classic", "iso", month)

    def damaged(kind: str):
        modulus, rest = DAMAGE[kind]
        return F.col("bikeid").cast("bigint") % modulus == rest

    intact = ~damaged("short") & ~damaged("long")
    bad_time = intact & damaged("time")
    raw = raw.withColumns({
        "starttime": F.when(bad_time, F.lit(MALFORMED_TIMES[1])).otherwise(F.col("starttime")),
        "start station latitude": F.when(intact & ~bad_time & damaged("coordinate"), F.lit("n/a"))
        .otherwise(F.col("start station latitude")),
    })
    cells = [F.coalesce(F.col(c), F.lit("")) for c in CLASSIC_HEADER]
    whole = F.concat_ws(",", *cells)
    line = (F.when(damaged("short"), F.concat_ws(",", *cells[:SHORT_CELLS]))
            .when(damaged("long"), F.concat(whole, F.lit(",extra"))).otherwise(whole))
    return raw.select(line.alias(",".join(CLASSIC_HEADER)))
