"""Every registered query against its SQL, on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare.difference(df, con, sql) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "tag", "step", "wall_time", "value", "count"] and df.count() > 0
