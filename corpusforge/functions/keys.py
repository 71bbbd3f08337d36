"""Seeded hash keys: reproducible shuffles, splits and samples.

``md5('<seed>:<id>')`` is a pure function of the row, so an order or a
threshold built on it is identical under any partitioning, on re-execution
after executor loss, and in a SQL engine (DuckDB has the same md5).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

TWO_32 = 4294967296.0


def hash_key(id_col, seed: int | str = 42) -> Column:
    """Lower-case hex md5 of ``'<seed>:<id>'``; sorts like a random permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_of(id_col).cast("string")))


def hash_unit(id_col, seed: int | str = 42) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of the key."""
    top = F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return top / F.lit(TWO_32)


def hash_bucket(id_col, seed: int | str = 42, hex_digits: int = 4) -> Column:
    """Leading hex digits of the key as an int: buckets that follow key order."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, hex_digits), 16, 10).cast("int")
