"""Recorded changes: an append-only log of ops that consumers drain, and map ops (an extension of diff)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .maps import entries

# Op numbers that only recorders write.
MAP_SET, MAP_DELETE = 9, 10


def op_log(changes: DataFrame, key: str, at: str, ops: str = "ops") -> DataFrame:
    """(key, seq, field_num, type, index, value): ops of a key by time, then by their own order; seq from 1."""
    rows = changes.select(key, at, F.posexplode(ops).alias("_pos", "_op"))
    seq = F.row_number().over(W.partitionBy(key).orderBy(at, "_pos"))
    return rows.select(key, seq.cast("long").alias("seq"), "_op.*")


def pending(log: DataFrame, key: str, drained: DataFrame) -> DataFrame:
    """Ops after the last seq that ``drained`` (key, seq) names for their key; all of keys that it lacks."""
    last = drained.groupBy(key).agg(F.max("seq").alias("_last"))
    return log.join(last, key, "left").where(F.col("seq") > F.coalesce("_last", F.lit(0))).drop("_last")


def map_diff(old: Column, new: Column) -> Column:
    """Extension: array of (type, key, value) by key, deletes first; equal entries give none."""
    gone = F.transform(F.filter(entries(old), lambda e: ~F.map_contains_key(new, e["key"])), lambda e: F.struct(F.lit(MAP_DELETE).alias("type"), e["key"].alias("key"), F.when(F.lit(False), e["value"]).alias("value")))
    put = F.transform(F.filter(entries(new), lambda e: ~F.try_element_at(old, e["key"]).eqNullSafe(e["value"])), lambda e: F.struct(F.lit(MAP_SET).alias("type"), e["key"].alias("key"), e["value"].alias("value")))
    return F.concat(gone, put)
