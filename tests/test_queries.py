"""Every registered query against its check SQL at the smallest scale."""
import pytest

import __spark_entry__ as entry
from tools.check import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(CHECKS) <= set(entry.queries())


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == sql_rows(con, CHECKS[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
