import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all odd kinds as (rows, DataFrame)."""
    rows = brute.docs()
    return rows, brute.frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    """Documents without a row."""
    return brute.frame(spark, [])
