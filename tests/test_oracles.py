"""Every query with an SQL twin gives the same rows."""

import pytest
from compare import compare, connection

from conftest import FOLDER
from kerbline.catalog import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    state, _, note = compare(spark, con, FOLDER, name, QUERIES, ORACLES)
    assert state == "ok", note
