"""Repeatable pseudo-random numbers from ids.

The result depends on the id alone, not on partitioning or on a retry, so a task
that runs again after an executor is lost gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A linear congruential generator modulo 2**31.
MULTIPLIER = 1103515245
INCREMENT = 12345
MODULUS = 2147483648


def _step(state: Column) -> Column:
    return F.pmod(
        state * F.lit(MULTIPLIER).cast("bigint") + F.lit(INCREMENT).cast("bigint"),
        F.lit(MODULUS).cast("bigint"),
    )


def mix(key: Column, seed: int = 42) -> Column:
    """An integer in [0, 2**31) for an integer key.

    Two steps of the generator with the high bits folded into the low ones in
    between. A key of another type is passed as ``mix(F.xxhash64(key))``.
    """
    start = F.pmod(key.cast("bigint"), F.lit(2147483647).cast("bigint"))
    first = _step(start + F.lit(seed * 7919).cast("bigint"))
    return _step(F.shiftright(first, 15).bitwiseXOR(first))


def unit(key: Column, seed: int = 42) -> Column:
    """A double in [0, 1)."""
    return mix(key, seed) / F.lit(float(MODULUS))
