"""Every query against its SQL counterpart on the smallest tables."""

import pytest

import check
import __spark_entry__ as catalogue

FOLDER = "/root/testdata/sf0.001"
SQLS = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_sql(spark, con, name):
    assert check.compare(spark, con, FOLDER, name, SQLS[name]) is None


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(catalogue.queries())


def test_entry(spark):
    assert catalogue.entry(spark).count() > 0
