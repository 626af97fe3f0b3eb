"""Registered queries against their SQL on the smallest tables."""

import pytest

from tessera.plans.catalogue import oracle_sql, queries
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", oracle_sql())
def test_query(spark, duck, name):
    assert rows_of(queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())


def test_each_query_has_a_name_of_its_own():
    assert oracle_sql().keys() <= queries().keys() and len(queries()) > 130


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
