"""Every registered query runs, and equals its SQL twin where it has one."""

import pytest

import __spark_entry__ as entry
import oracle_check

SF = "/root/testdata/sf0.001"
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, con, name):
    problem, _ = oracle_check.compare(spark, con, SF, entry.queries()[name], TWINS[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
