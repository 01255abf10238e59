"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from workload.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name)) is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert {"ecosystem", "package_key", "total_repo_count", "matched_repo_count"} <= set(frame.columns)
    assert frame.count() > 0
