"""Deterministic pseudo-random keys.

Every random choice in the library is an order by an md5 digest of the seed and
the row's ids, so a result does not depend on the partitioning of its input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed, *cols) -> Column:
    """Hex digest of ``seed|col|col…``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols]))


def digest_int(key: Column, start: int = 1, digits: int = 7) -> Column:
    """``digits`` hex characters of a digest as a non-negative long."""
    return F.conv(F.substring(key, start, digits), 16, 10).cast("long")


def digest_bucket(key: Column, digits: int = 2) -> Column:
    """Leading hex characters as an int: monotone in the digest, evenly filled."""
    return digest_int(key, 1, digits).cast("int")


def uniform(key: Column, start: int = 1) -> Column:
    """Uniform number in (0, 1) from 13 hex characters of a digest."""
    return (digest_int(key, start, 13).cast("double") + F.lit(0.5)) / F.lit(float(16**13))
