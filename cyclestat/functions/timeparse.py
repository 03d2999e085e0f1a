"""Trip time text -> ``TIMESTAMP_NTZ``.

The feed used three layouts over the years::

    yyyy-MM-dd HH:mm:ss      2013-07-01 00:00:00
    MM/dd/yyyy HH:mm:ss      09/01/2014 00:00:25
    MM/dd/yyyy HH:mm         01/31/2015 23:59   (also 1/1/2015 0:01)

Instead of choosing a pattern per file, the layout is recognised per value: the
trimmed text must match one anchored pattern per layout as a whole, so nothing
malformed is rewritten into something valid.  US text is then put in ISO order by
plain string splits and cast.  Spark's string -> timestamp cast accepts one- or
two-digit fields, and the cast to ``TIMESTAMP_NTZ`` is wall-clock, so no session
time zone and no DST gap can move the value.  Sub-second digits are dropped (the
feed's times are whole seconds).  Text in no known layout becomes NULL; it never
fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclestat.functions._util import as_col

# Accepted text: one- or two-digit fields, sub-seconds only after seconds.
_TIME = r"\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?"
_LAYOUT = rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}) {_TIME}\z"

LAYOUTS = ("iso", "us", "us_short")


def _us_to_iso(s: Column) -> Column:
    """``M/d/yyyy H:mm[:ss]`` -> ``yyyy-M-d H:mm[:ss]`` with plain string splits
    (no regular expression: this runs once per time value of the feed)."""
    date, time = F.substring_index(s, " ", 1), F.substring_index(s, " ", -1)
    month = F.substring_index(date, "/", 1)
    day = F.substring_index(F.substring_index(date, "/", 2), "/", -1)
    year = F.substring_index(date, "/", -1)
    return F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), time)


def parse_trip_time(text: str | Column) -> Column:
    """Parse trip time text in any of the feed's layouts to ``TIMESTAMP_NTZ``."""
    s = F.trim(as_col(text))
    whole = F.when(s.contains("."), F.substring_index(s, ".", 1)).otherwise(s)  # drop sub-second digits
    iso = F.when(whole.contains("/"), _us_to_iso(whole)).otherwise(whole)
    return F.when(s.rlike(_LAYOUT), iso.try_cast("timestamp_ntz"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def render_trip_time(ts: str | Column, layout: str) -> Column:
    """Render a ``TIMESTAMP_NTZ`` as feed text in one of :data:`LAYOUTS`.

    Built from calendar fields (zone-free on NTZ) rather than
    ``date_format``, which consults the session zone.  ``us_short`` writes
    one-digit month, day and hour the way part of the feed did; ``day_first``
    (``dd/MM/yyyy HH:mm:ss``) is no feed layout and serves to produce the
    mistaken text a reject count must catch.
    """
    t = as_col(ts)
    y = F.year(t).cast("string")
    mo, d, h = F.month(t), F.dayofmonth(t), F.hour(t)
    mi, s = _two(F.minute(t)), _two(F.second(t))
    if layout == "iso":
        return F.concat(y, F.lit("-"), _two(mo), F.lit("-"), _two(d), F.lit(" "),
                        _two(h), F.lit(":"), mi, F.lit(":"), s)
    if layout == "us":
        return F.concat(_two(mo), F.lit("/"), _two(d), F.lit("/"), y, F.lit(" "),
                        _two(h), F.lit(":"), mi, F.lit(":"), s)
    if layout == "us_short":
        return F.concat(mo.cast("string"), F.lit("/"), d.cast("string"), F.lit("/"), y, F.lit(" "),
                        h.cast("string"), F.lit(":"), mi)
    if layout == "day_first":  # not a feed layout: a month written dd/MM/yyyy by mistake
        return F.concat(_two(d), F.lit("/"), _two(mo), F.lit("/"), y, F.lit(" "),
                        _two(h), F.lit(":"), mi, F.lit(":"), s)
    raise ValueError(f"unknown layout {layout!r}; expected one of {LAYOUTS} or 'day_first'")
