"""Sorted maps: MapType for lookup, key-sorted entries wherever order or equality counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(m: Column) -> Column:
    return F.coalesce(F.size(m), F.lit(0))


def get(m: Column, key) -> Column:
    """The value, null if the key is absent (values are never null)."""
    return F.try_element_at(m, _c(key))


def has(m: Column, key) -> Column:
    return F.map_contains_key(m, _c(key))


def put(m: Column, key, value) -> Column:
    return F.map_concat(delete(m, key), F.create_map(_c(key), _c(value)))


def delete(m: Column, key) -> Column:
    return F.map_filter(m, lambda k, _: k != _c(key))


def clear(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.lit(False))


def entries(m: Column) -> Column:
    """Entries by key: false before true, numbers by value, strings by byte."""
    return F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    return F.transform(entries(m), lambda e: e["value"])


def metadata(pairs: Column) -> Column:
    """Map of lower-cased keys from an array of (key, value); of equal keys the last counts."""
    low = F.transform(pairs, lambda p: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value")))
    last = F.filter(low, lambda p, i: ~F.exists(F.slice(low, (i + 2).cast("int"), F.size(low)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)
