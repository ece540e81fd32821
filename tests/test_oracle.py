"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import pytest

from lidarlake.catalog import all_oracles, all_queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
# Frame rounds take minutes; run them with LIDARLAKE_SLOW=1 or through tests.compare.
SLOW = {"localize_frame", "tracking_fusion"}
NAMES = [n for n in all_oracles() if os.environ.get("LIDARLAKE_SLOW") or n not in SLOW]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    diff, _ = compare(spark, con, all_queries()[name], all_oracles()[name], SF)
    assert diff is None, diff
