"""Field-level diff of two records, as native expressions built from the schema.

An op is (field_num, type, index, value): value is text, JSON for composites, so
that ops are one flat table.  Type 3 and 8 carry the ops of the nested struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.presence import value as filled
from quern.functions.schema import Struct
from quern.functions.types import Ref

# Op numbers.
SET, CLEAR, STRUCT_PATCH, LIST_REPLACE, LIST_SET, LIST_INSERT, LIST_REMOVE, LIST_STRUCT_PATCH = 1, 2, 3, 4, 5, 6, 7, 8
VERSION = 1
OP = "struct<field_num:int,type:int,index:int,value:string>"


class NotPatchable(ValueError):
    pass


def op(num: int, kind: int, index, text: Column | None = None) -> Column:
    index = index if isinstance(index, Column) else F.lit(index)
    return F.struct(F.lit(num).alias("field_num"), F.lit(kind).alias("type"), index.cast("int").alias("index"), (F.lit(None).cast("string") if text is None else text).alias("value"))


def text_of(col: Column, ref: Ref) -> Column:
    """Lossless text of a value: hex for bytes, JSON for composites."""
    if ref.scalar == "bytes":
        return F.hex(col)
    return col.cast("string") if ref.scalar else F.to_json(col)


def differs(old: Column, new: Column) -> Column:
    """NaN equals NaN, -0.0 equals 0.0."""
    return ~old.eqNullSafe(new)


def diff(old: Column, new: Column, struct: Struct, structs: dict[str, Struct]) -> Column:
    """Array of the ops that turn ``old`` into ``new``, in field order; both are structs of ``struct``.

    Fields that are null count as zero or empty.  Maps and Any are refused.
    """
    parts = [_field(old[f.name], new[f.name], f.num, f.ref, structs) for f in struct.fields]
    return F.concat(*parts) if parts else F.array().cast(f"array<{OP}>")


def _one(when: Column, made: Column) -> Column:
    return F.filter(F.array(F.when(when, made)), lambda o: o.isNotNull())


def _field(old: Column, new: Column, num: int, ref: Ref, structs: dict[str, Struct]) -> Column:
    if ref.kind in ("map", "any") or ref.kind == "list" and ref.item.kind in ("any", "map"):
        raise NotPatchable(f"field {num}: maps and Any have no patch form")
    if ref.kind == "list":
        return _list(filled(old, ref, structs), filled(new, ref, structs), num, ref, structs)
    if ref.kind == "struct":
        nested = diff(old, new, structs[ref.name], structs)
        made = F.when(old.isNull() & new.isNotNull(), op(num, SET, -1, F.to_json(new)))
        made = made.when(old.isNotNull() & new.isNull(), op(num, CLEAR, -1))
        made = made.when(old.isNotNull() & new.isNotNull() & (F.size(nested) > 0), op(num, STRUCT_PATCH, -1, F.to_json(nested)))
        return F.filter(F.array(made), lambda o: o.isNotNull())
    a, b = filled(old, ref), filled(new, ref)
    if ref.scalar in ("string", "bytes"):
        return _one(differs(a, b), F.when(F.octet_length(b) == 0, op(num, CLEAR, -1)).otherwise(op(num, SET, -1, text_of(b, ref))))
    return _one(differs(a, b), op(num, SET, -1, text_of(b, ref)))


def _list(old: Column, new: Column, num: int, ref: Ref, structs: dict[str, Struct]) -> Column:
    """Positional edits; one replacement if edits outnumber half of both lengths."""
    n, m, item = F.size(old), F.size(new), ref.item
    both = F.arrays_zip(F.slice(old, 1, F.least(n, m)).alias("a"), F.slice(new, 1, F.least(n, m)).alias("b"))
    if item.kind == "struct":
        def changed(x, i):
            nested = diff(x["a"], x["b"], structs[item.name], structs)
            return F.when(F.size(nested) > 0, op(num, LIST_STRUCT_PATCH, i, F.to_json(nested)))
    else:
        def changed(x, i):
            return F.when(differs(x["a"], x["b"]), op(num, LIST_SET, i, text_of(x["b"], item)))
    sets = F.filter(F.transform(both, changed), lambda o: o.isNotNull())
    inserts = F.transform(F.slice(new, n + 1, F.greatest(m - n, F.lit(0))), lambda x, i: op(num, LIST_INSERT, i + n, text_of(x, item)))
    removes = F.transform(F.slice(old, m + 1, F.greatest(n - m, F.lit(0))), lambda _, i: op(num, LIST_REMOVE, n - 1 - i))
    ops = F.concat(sets, inserts, removes)
    return F.when(F.size(ops) > F.floor((n + m) / 2), F.array(op(num, LIST_REPLACE, -1, F.to_json(new)))).otherwise(ops)


def is_empty(ops: Column) -> Column:
    return F.size(ops) == 0


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, struct: Struct, structs: dict[str, Struct]) -> DataFrame:
    """(key, change, ops): one row per key of either snapshot; one shuffle join on the key.

    change is insert, delete, update or same; inserts and deletes have no ops.
    """
    names = [f.name for f in struct.fields]
    a = before.select(F.col(key).alias("_a"), F.struct(*names).alias("old"))
    b = after.select(F.col(key).alias("_b"), F.struct(*names).alias("new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    ops = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), diff(F.col("old"), F.col("new"), struct, structs)).otherwise(F.array().cast(f"array<{OP}>"))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.size("ops") > 0, "update").otherwise("same")
    return both.select(F.coalesce("_a", "_b").alias(key), "_a", "_b", ops.alias("ops")).select(key, change.alias("change"), "ops")
