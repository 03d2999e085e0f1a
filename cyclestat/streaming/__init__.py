"""Structured Streaming form of the feed ingest.

The source analysis reads finished monthly files; nothing in it is stateful
over time.  Its ingest (scan, header mapping, time and number repair) is a
chain of stateless per-row expressions, so the same operators run unchanged
on a stream of newly landed monthly files, and the grouped-count reports
(station uses, start/end counts, hourly usage) are kept up to date on that
stream with bounded state (``running``).
"""

from cyclestat.streaming.ingest_stream import stream_trip_csvs, write_trips_stream
from cyclestat.streaming.running import latest_version, publish_running, running_report

__all__ = ["stream_trip_csvs", "write_trips_stream", "running_report", "publish_running", "latest_version"]
