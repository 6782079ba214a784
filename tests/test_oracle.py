"""Every registered query against its SQL over whole tables."""

import pytest

from check_oracle import compare, database
from conftest import SF_TINY
from workload import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SF_TINY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF_TINY, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
