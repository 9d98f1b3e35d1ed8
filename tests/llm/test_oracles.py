"""Registered queries against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from tuneprep.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    con = oracle.connect(SF_DIR)
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR) is None
