"""Registered queries against their SQL oracles on the smallest tables."""

import pytest

from assay.plans.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf_dir, con):
    problem = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert problem is None, problem


def test_entry_point(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
