"""Records as JSON: names or numbers for enums, base64 for bytes, null for absent composites and non-finite floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.presence import value as filled
from quern.functions.schema import Enum, Struct
from quern.functions.types import Ref, spark_type
from quern.operators.enums import name_of, number_of

KEEP_NULLS = {"ignoreNullFields": "false"}


def shaped(col: Column, ref: Ref, structs: dict[str, Struct], enums: dict[str, Enum], numbers: bool = False) -> Column:
    """The value as to_json shall print it."""
    if ref.kind == "enum":
        return filled(col, ref) if numbers or ref.name not in enums else name_of(filled(col, ref), enums[ref.name])
    if ref.scalar in ("float32", "float64"):
        x = filled(col, ref)
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    if ref.scalar == "bytes":
        return F.base64(filled(col, ref))
    if ref.scalar:
        return filled(col, ref)
    if ref.kind == "any":
        return F.when(col.isNotNull(), F.struct(F.lower(F.hex(col["hash"])).alias("@type"), F.base64(col["data"]).alias("@value")))
    if ref.kind == "struct":
        return F.when(col.isNotNull(), record(col, structs[ref.name], structs, enums, numbers))
    if ref.kind == "list":
        return F.when(F.size(col) > 0, F.transform(col, lambda x: shaped(x, ref.item, structs, enums, numbers)))
    return F.when(F.size(col) > 0, F.map_from_entries(F.transform(F.array_sort(F.map_entries(col), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: F.struct(e["key"].cast("string"), shaped(e["value"], ref.item, structs, enums, numbers)))))


def record(col: Column, struct: Struct, structs: dict, enums: dict, numbers: bool = False) -> Column:
    return F.struct(*[shaped(col[f.name], f.ref, structs, enums, numbers).alias(f.name) for f in struct.fields])


def to_json(col: Column, struct: Struct, structs: dict, enums: dict | None = None, numbers: bool = False) -> Column:
    return F.to_json(record(col, struct, structs, enums or {}, numbers), KEEP_NULLS)


def from_json(text: Column, struct: Struct, structs: dict, enums: dict | None = None, ignore_unknown: bool = False) -> Column:
    """The record of a JSON object (scalars, nested structs and lists); enum names or numbers; bad JSON fails.

    Unknown fields of the object fail too unless they are ignored.
    """
    enums = enums or {}
    parts = []
    for f in struct.fields:
        if f.ref.kind == "enum" and f.ref.name in enums:
            raw = F.get_json_object(text, f"$.{f.name}")
            parts.append(F.coalesce(F.when(raw.rlike(r"^\d+$"), raw.cast("int")).otherwise(number_of(raw, enums[f.ref.name])), F.lit(0)).cast(spark_type(f.ref)).alias(f.name))
        else:
            t = spark_type(f.ref, structs)
            parts.append(filled(F.from_json(text, f"struct<`{f.name}`:{t.simpleString()}>", {"mode": "FAILFAST"})[f.name], f.ref, structs).alias(f.name))
    unknown = F.array_except(F.json_object_keys(text), F.array(*[F.lit(f.name) for f in struct.fields]))
    out = F.struct(*parts)
    return out if ignore_unknown else F.when(F.size(unknown) == 0, out).otherwise(F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ","))))


def json_arrays(df: DataFrame, by: str, text: Column, order: Column) -> DataFrame:
    """One JSON array of the texts of each ``by``, in ``order``."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return df.groupBy(by).agg(F.concat(F.lit("["), F.array_join(F.transform(parts, lambda x: x["t"]), ","), F.lit("]")).alias("json"))
