"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest
from check_oracle import compare, connect

from edgeloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    error, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert error is None or (name not in ORACLES and error == "no rows")
