import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]")
         .appName("cyclestat-tests")
         .config("spark.sql.shuffle.partitions", os.environ.get("CYCLESTAT_TEST_PARTITIONS", "8"))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", os.environ.get("CYCLESTAT_TEST_TZ", "UTC"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
