"""Token-id arrays: bounds, padding, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentspark.functions.text import END, PAD, START


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_bounds(ids: Column | str) -> Column:
    """Start id, the ids, end id."""
    return F.concat(F.array(F.lit(START)), _col(ids), F.array(F.lit(END)))


def pad(ids: Column | str, length: Column, pad_id: int = PAD) -> Column:
    ids = _col(ids)
    return F.concat(ids, F.array_repeat(F.lit(pad_id), (length - F.size(ids)).cast("int")))


def padding_mask(ids: Column | str, length: Column) -> Column:
    """True where padding stands."""
    n = F.size(_col(ids))
    return F.concat(
        F.array_repeat(F.lit(False), n), F.array_repeat(F.lit(True), (length - n).cast("int"))
    )


def attention_mask(ids: Column | str, length: Column) -> Column:
    """1 where a token stands, 0 on padding."""
    n = F.size(_col(ids))
    return F.concat(
        F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), (length - n).cast("int"))
    )
