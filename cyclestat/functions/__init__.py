"""Column-expression builders (no DataFrame in, Column out).

Everything here is a composition of built-in ``pyspark.sql.functions``;
nothing leaves the JVM, so whole-stage codegen stays unbroken.
"""

from cyclestat.functions.calendar import (
    day_label,
    day_label_of,
    epoch_seconds,
    hour_in,
    is_weekday_trip,
    is_weekend_trip,
    trip_length_seconds,
)
from cyclestat.functions.geo import (
    LONG_ISLAND_FEET,
    LambertConformalConic,
    interpolate,
    in_viewport,
)
from cyclestat.functions.timeparse import parse_trip_time, render_trip_time

__all__ = [
    "day_label",
    "day_label_of",
    "epoch_seconds",
    "hour_in",
    "is_weekday_trip",
    "is_weekend_trip",
    "trip_length_seconds",
    "LONG_ISLAND_FEET",
    "LambertConformalConic",
    "interpolate",
    "in_viewport",
    "parse_trip_time",
    "render_trip_time",
]
