"""Every named query against its SQL counterpart on the smallest tables."""

import os

import pytest
from check import compare

from framelake.plans import catalog, oracles

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracles.oracles())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    assert compare(spark, catalog.queries()[name], oracles.oracles()[name], SMALL) is None
