"""Seeded random draws as columns.

A draw is a pure function of a seed, a purpose and row ids, so it is the same on every
partitioning, on every retry of a task, and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, purpose: str, *ids: Column | str) -> Column:
    """32 lower-case hex digits; sorting by them is a random order."""
    parts = [F.lit(f"{seed}:{purpose}")]
    parts += [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts))


def uniform(key: Column, digit: int = 1) -> Column:
    """A number in [0, 1) from the 8 hex digits of ``key`` that start at ``digit``."""
    return F.conv(F.substring(key, digit, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def below(key: Column, n: int, digit: int = 1) -> Column:
    """An int in [0, n) from the same digits."""
    return F.floor(uniform(key, digit) * F.lit(n)).cast("int")
