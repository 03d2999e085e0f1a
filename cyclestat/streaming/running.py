"""Running reports over a stream of trips.

The station and time-of-use tables are grouped counts, so the batch
operators run unchanged on a streaming DataFrame: Spark keeps one state row
per group (bounded by stations or hours, never by trips) in a state store
checkpointed under shared storage, and every trigger publishes the updated
table: its full result goes to a new folder ``version=<batch>`` under the sink
path, which a reader takes when Spark's ``_SUCCESS`` mark is there
(:func:`latest_version`); earlier versions are never touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cyclestat.operators import stations, usage

RUNNING = {
    "station_uses": stations.station_uses,
    "start_station_counts": stations.start_station_counts,
    "end_station_counts": stations.end_station_counts,
    "hourly_usage": usage.hourly_usage,
}


def running_report(trips_stream: DataFrame, report: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A grouped-count report applied to a streaming trips DataFrame."""
    fn = RUNNING[report] if isinstance(report, str) else report
    return fn(trips_stream)


def publish_running(result: DataFrame, path: str, checkpoint_location: str,
                    available_now: bool = True) -> StreamingQuery:
    """Write the complete current result as a new version under ``path`` on every trigger.
    A batch that is run again after a failure replaces its own version only."""
    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    w = (result.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version under ``path``, or None."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().getParent() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS")) or []]
    if not done:
        return None
    return spark.read.parquet(max((p for p in done), key=lambda p: int(p.getName().split("=")[1])).toString())
