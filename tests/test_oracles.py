"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from duck import assert_same, connect

from quarry.oracles import ORACLES
from quarry.queries import REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(REGISTRY[name](spark, sf_dir), con, ORACLES[name])


def test_queries_without_sql_are_known():
    assert set(REGISTRY) - set(ORACLES) == set()
