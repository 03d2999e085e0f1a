import pytest


@pytest.fixture(scope="session", autouse=True)
def _folders(spark, tmp_path_factory):
    """Shared storage of the tests: the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
