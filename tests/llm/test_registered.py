"""The registered queries of this package against their SQL checks on the smallest tables."""

import pytest

from bomatlas.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name, QUERIES[name], ORACLES[name]) is None
