"""Every catalogue query against its SQL twin on the smallest data set."""

import check
import pytest

from conftest import SF
from mediaframe import catalog

catalog.load()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    message, _, ok = check.compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert ok, message
