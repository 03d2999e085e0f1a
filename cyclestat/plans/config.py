"""Session settings this library is designed for.

The library never changes session settings itself; jobs and tests apply
these when they build their own session.  At cluster scale the shuffle
partition count should give 100-200 MB per partition of the largest shuffle
(trips x ~40 bytes after column pruning), e.g. several thousand partitions
for a 100 TB trip feed; AQE then coalesces small stages.
"""

from __future__ import annotations

RECOMMENDED = {
    # adaptive execution: coalesces small shuffles, converts joins whose
    # measured side is small into broadcast joins, splits skewed join parts.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # 128 MB input splits: one task per split of the CSV / Parquet scan.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def local_settings(cpus: int) -> dict[str, str]:
    """Settings for a single-machine run with ``cpus`` threads."""
    return {**RECOMMENDED, "spark.sql.shuffle.partitions": str(max(cpus, 1)),
            "spark.ui.enabled": "false"}
