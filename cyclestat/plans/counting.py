"""Counting trips, from trips or from facts.

A facts table (:mod:`cyclestat.operators.facts`) is trips already grouped, with
the number of trips of each group in ``trip_count``.  Operators that count trips
sum that column where it is present and 1 where it is not, so one operator
serves both inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIP_COUNT = "trip_count"
PERIOD = "trip_period"
DAY_TYPE = "trip_day_type"


def trip_weight(df: DataFrame) -> Column:
    """How many trips a row stands for (bigint)."""
    return F.col(TRIP_COUNT) if TRIP_COUNT in df.columns else F.lit(1).cast("bigint")


def count_trips(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Trips per ``keys``: ``count`` bigint."""
    return df.groupBy(*keys).agg(F.sum(trip_weight(df)).alias("count"))
