"""List operators with 0-based places; errors are raised, never padded over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0))


def append(arr: Column, *values) -> Column:
    return F.concat(arr, F.array(*[_c(v) for v in values]))


def get(arr: Column, i) -> Column:
    """Item ``i``; fails the query out of range."""
    return F.when((_c(i) >= 0) & (_c(i) < F.size(arr)), F.get(arr, _c(i))).otherwise(F.raise_error(F.lit("list index out of range")))


def put(arr: Column, i, value) -> Column:
    """Item ``i`` replaced; fails the query out of range."""
    inside = (_c(i) >= 0) & (_c(i) < F.size(arr))
    return F.when(inside, F.transform(arr, lambda x, k: F.when(k == _c(i), _c(value)).otherwise(x))).otherwise(F.raise_error(F.lit("list index out of range")))


def between(arr: Column, start, end) -> Column:
    """Items from ``start`` up to ``end``, both clamped to the list."""
    a = F.greatest(_c(start), F.lit(0))
    return F.slice(arr, (a + 1).cast("int"), F.greatest(F.least(_c(end), F.size(arr)) - a, F.lit(0)).cast("int"))


def insert(arr: Column, i, value) -> Column:
    """``value`` before place ``i`` (up to the length); null out of range."""
    ok = (_c(i) >= 0) & (_c(i) <= F.size(arr))
    return F.when(ok, F.concat(F.slice(arr, 1, F.greatest(_c(i), F.lit(0)).cast("int")), F.array(_c(value)), F.slice(arr, (F.greatest(_c(i), F.lit(0)) + 1).cast("int"), F.size(arr))))


def remove(arr: Column, i) -> Column:
    """Without item ``i``; null out of range."""
    return F.when((_c(i) >= 0) & (_c(i) < F.size(arr)), F.filter(arr, lambda x, k: k != _c(i)))


def edit_error(op: str, arr: Column, i) -> Column:
    """"" or why an edit cannot be made."""
    most = F.size(arr) + (1 if op == "insert" else 0)
    return F.when((_c(i) >= 0) & (_c(i) < most), "").otherwise(f"{op}: index out of range")
