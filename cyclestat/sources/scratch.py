"""Shared scratch storage.

Intermediate files are written under the cluster's checkpoint folder
(``spark.checkpoint.dir``), which a cluster points at shared storage.  Only a
local master may do without one: a local folder is then created and registered.
On a cluster that is an error, since other machines could not read it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def is_local(spark: SparkSession) -> bool:
    """One machine runs everything (master ``local``, ``local[n]``, ``local[n,f]``)."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="cyclestat-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under ``<checkpoint dir>/cyclestat/<application id>/...``."""
    app = spark.sparkContext.applicationId
    return "/".join([checkpoint_root(spark), "cyclestat", app, *parts])


def warehouse_path(spark: SparkSession, *parts: str) -> str:
    """A path under the session's warehouse folder.  The default of that is a folder of the machine the
    driver runs on: where a cluster's session left it so, a path under the checkpoint folder, which its
    machines share, the same for each application."""
    at = spark.conf.get("spark.sql.warehouse.dir")
    default = os.path.join(os.getcwd(), "spark-warehouse")
    if not is_local(spark) and unquote(urlsplit(at).path).rstrip("/") == default and urlsplit(at).scheme in ("", "file"):
        at = f"{checkpoint_root(spark)}/cyclestat/warehouse"
    return "/".join([at.rstrip("/"), *parts])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused scratch path for one write."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
