"""Every registered query against its SQL counterpart on the smallest data folder."""

import os

import oracle
import pytest

from tuneprep.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR) is None
