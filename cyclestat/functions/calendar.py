"""Calendar expressions on trip times.

All of them read ``TIMESTAMP_NTZ`` wall-clock fields (``dayofweek``,
``hour``, ``unix_timestamp``), which do not depend on the session time zone.
Day labels come from the ordinal, not from ``date_format(ts, 'E')``, for the
same reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclestat import schema as S
from cyclestat.functions._util import as_col

_SATURDAY, _SUNDAY = 7, 1


def day_label_of(ordinal: str | Column) -> Column:
    """``Sun`` .. ``Sat`` for a ``dayofweek`` ordinal 1..7 (NULL otherwise).

    Uses 0-based ``get``: in Spark 4.1, ``element_at`` on a literal array
    returns the last element for a NULL index instead of NULL.
    """
    labels = F.array(*[F.lit(x) for x in S.DAY_LABELS])
    return F.get(labels, as_col(ordinal) - 1)


def day_label(ts: str | Column) -> Column:
    """``Sun`` .. ``Sat`` for a timestamp (NULL for NULL)."""
    return day_label_of(F.dayofweek(as_col(ts)))


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 00:00:00 of the wall clock (floor)."""
    return F.unix_timestamp(as_col(ts))


def epoch_seconds_in(ts: str | Column, zone: str) -> Column:
    """Whole epoch seconds (floor) at which clocks in ``zone`` show ``ts``.

    A time shown twice, when clocks go back, is its first showing; one that is skipped, when
    they go forward, is taken by the clock from before the change.
    """
    return epoch_seconds(F.convert_timezone(F.lit(zone), F.lit("UTC"), as_col(ts)))


def trip_length_seconds(start: str | Column, stop: str | Column, zone: str | None = None) -> Column:
    """Difference of whole epoch seconds; negative and zero lengths pass.

    Without ``zone`` times are read off the wall clock, so a trip over a clock change is an hour off; with
    it, times are clock times of that zone and the length is the time that passed.
    """
    if zone is None:
        return epoch_seconds(stop) - epoch_seconds(start)
    return epoch_seconds_in(stop, zone) - epoch_seconds_in(start, zone)


def _is_weekend_day(ts: Column) -> Column:
    return F.dayofweek(ts).isin(_SUNDAY, _SATURDAY)


def is_weekday_trip(start: str | Column = S.STARTTIME, stop: str | Column = S.STOPTIME,
                    max_seconds: int = S.MAX_TRIP_SECONDS, zone: str | None = None) -> Column:
    """At most ``max_seconds`` long (inclusive; in ``zone``, if given) and both ends on Mon-Fri.

    A NULL time gives NULL, which a filter drops.  Fri->Sat and Sun->Mon
    trips are in neither the weekday nor the weekend set.
    """
    a, b = as_col(start), as_col(stop)
    return ((trip_length_seconds(a, b, zone) <= max_seconds)
            & ~_is_weekend_day(a) & ~_is_weekend_day(b))


def is_weekend_trip(start: str | Column = S.STARTTIME, stop: str | Column = S.STOPTIME,
                    max_seconds: int = S.MAX_TRIP_SECONDS, zone: str | None = None) -> Column:
    """At most ``max_seconds`` long (inclusive; in ``zone``, if given) and both ends on Sat/Sun."""
    a, b = as_col(start), as_col(stop)
    return ((trip_length_seconds(a, b, zone) <= max_seconds)
            & _is_weekend_day(a) & _is_weekend_day(b))


def hour_in(ts: str | Column, hours) -> Column:
    """Hour of day of ``ts`` is one of ``hours``."""
    return F.hour(as_col(ts)).isin(*hours)
