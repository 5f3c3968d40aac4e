"""Bit operators on unsigned values held in longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(start: int, end: int) -> int:
    """Ones in the bits from ``start`` up to ``end``."""
    if not 0 <= start < end <= 63:
        raise ValueError("a mask needs 0 <= start < end <= 63")
    return ((1 << (end - start)) - 1) << start


def get_bit(x: Column, at: int) -> Column:
    return F.getbit(x, F.lit(at)) == 1


def set_bit(x: Column, at: int, on: bool = True) -> Column:
    return x.bitwiseOR(F.lit(1 << at)) if on else clear_bit(x, at)


def clear_bit(x: Column, at: int) -> Column:
    return x.bitwiseAND(F.lit(~(1 << at)))


def clear_bits(x: Column, start: int, end: int) -> Column:
    return x.bitwiseAND(F.lit(~mask(start, end)))


def get_value(x: Column, start: int, end: int) -> Column:
    return F.shiftrightunsigned(x.bitwiseAND(F.lit(mask(start, end))), start)


def set_value(x: Column, value: Column, start: int, end: int) -> Column:
    """``value`` stored in the bits from ``start`` up to ``end``; what does not fit is cut off."""
    return clear_bits(x, start, end).bitwiseOR(F.shiftleft(value.cast("long"), start).bitwiseAND(F.lit(mask(start, end))))
