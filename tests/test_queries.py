"""Every reliability query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__
from plumbline.plans.queries import QUERIES

from .oracle import SF, assert_same


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name].run, QUERIES[name].sql)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_query_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 600
