"""Two grouped tables from which every aggregate report is answered.

``path_facts`` groups trips by both stations, period and subscriber flag;
``time_facts`` by day type, hours and start day.  Each is one map-side-combined
pass over the trips and far smaller than they are (station pairs, and a few
thousand rows), so a job reads the trips twice whatever the number of reports.
Both have the trips of a group in ``trip_count`` and work as input of the
operators in place of trips.

Facts can be kept per part of the trips (``parts``, e.g. the feed month).  Counts of parts add
up, and every operator adds the counts of equal keys, so the facts of all parts together
are the facts of all trips: nothing is merged before it is read, and a new or corrected
month makes its own part anew and no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.operators.paths import DIRECTED_KEYS, trip_period
from cyclestat.operators.usage import START_DAY, START_HOUR, STOP_HOUR, day_type_of
from cyclestat.plans.counting import DAY_TYPE, PERIOD, TRIP_COUNT


def path_facts(trips: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """(path keys, ``trip_period``, ``usertype`` Subscriber or NULL, ``trip_count``[, ``parts``])."""
    rider = F.when(F.col(S.USERTYPE) == S.SUBSCRIBER, F.lit(S.SUBSCRIBER))
    rows = trips.select(*DIRECTED_KEYS, trip_period(trips).alias(PERIOD), rider.alias(S.USERTYPE), *parts)
    facts = rows.groupBy(*DIRECTED_KEYS, PERIOD, S.USERTYPE, *parts).agg(F.count(F.lit(1)).alias(TRIP_COUNT))
    # A plan that reads the facts twice runs the aggregate once if both readers'
    # are alike.  The filter, true for every group, makes both need the count, and
    # a reader's own filters stay above the generator.
    return facts.where(F.col(TRIP_COUNT) > 0).select(F.inline(F.array(F.struct(*facts.columns))))


def time_facts(trips: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """(``trip_day_type``, ``start_hour``, ``stop_hour``, ``start_day``, ``trip_count``[, ``parts``])."""
    rows = trips.select(
        day_type_of(trips).alias(DAY_TYPE), F.hour(S.STARTTIME).alias(START_HOUR), F.hour(S.STOPTIME).alias(STOP_HOUR),
        F.dayofweek(S.STARTTIME).alias(START_DAY), *parts,
    )
    return rows.groupBy(DAY_TYPE, START_HOUR, STOP_HOUR, START_DAY, *parts).agg(F.count(F.lit(1)).alias(TRIP_COUNT))
