"""Every query of the catalogue against its SQL."""

import pytest
from compare import differences, duck

from tallystone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_each_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
