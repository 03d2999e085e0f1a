"""The registered queries against their SQL, and their columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, duck  # noqa: E402
from cyclestat.llm import oracle, queries  # noqa: E402

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, SF), duck(SF), oracle.SQL[name])
    assert ok, message
