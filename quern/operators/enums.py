"""Enum dictionaries as literals inside the plan: no join, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.schema import Enum


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def name_of(number: Column, enum: Enum, strict: bool = False) -> Column:
    """The name of ``number``; an unknown number is "" or, if strict, fails."""
    found = F.try_element_at(_map((v, k) for k, v in enum.values.items()), number.cast("int"))
    other = F.raise_error(F.concat(F.lit(f"{enum.name} has no number "), number.cast("string"))) if strict else F.lit("")
    return F.when(found.isNull(), other).otherwise(found)


def number_of(name: Column, enum: Enum, strict: bool = False) -> Column:
    """The number of ``name``; an unknown name is 0 or, if strict, fails."""
    found = F.try_element_at(_map(enum.values.items()), name)
    other = F.raise_error(F.concat(F.lit(f"{enum.name} has no name "), name)) if strict else F.lit(0)
    return F.when(found.isNull(), other).otherwise(found)


def listing(spark: SparkSession, enum: Enum) -> DataFrame:
    """(name, number, place by number, place by name)."""
    by_number, by_name = [n for n, _ in enum.by_value()], [n for n, _ in enum.by_name()]
    return spark.createDataFrame([(n, v, by_number.index(n), by_name.index(n)) for n, v in enum.values.items()], "name string, number int, by_number int, by_name int")
