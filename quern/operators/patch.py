"""Applying ops to records: one fold per field, in op order, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.presence import value as filled
from quern.functions.presence import zero
from quern.functions.schema import Struct
from quern.functions.types import Ref, spark_type

from . import arrays
from .diff import CLEAR, LIST_INSERT, LIST_REMOVE, LIST_REPLACE, LIST_SET, LIST_STRUCT_PATCH, OP, SET, STRUCT_PATCH, VERSION

#: Ops that one patch may hold, and the depth of nested patches.
MAX_OPS = 10_000
MAX_DEPTH = 100


def _parse(text: Column, ref: Ref, structs: dict[str, Struct]) -> Column:
    t = spark_type(ref, structs)
    if ref.scalar == "bytes":
        return F.unhex(text)
    return text.cast(t) if ref.scalar else F.from_json(text, t, {"mode": "FAILFAST"})


def apply(record: Column, ops: Column, struct: Struct, structs: dict[str, Struct], depth: int = 0, version: Column | None = None) -> Column:
    """``record`` after ``ops``; apply(a, diff(a, b)) is b.

    Unknown fields of the record itself and unknown op types are skipped, as a
    newer writer may know more.  What ``error`` names fails the query; use it to
    set such patches aside.
    """
    if depth > MAX_DEPTH:
        raise ValueError("patch is nested too deeply")
    if version is not None:
        return F.when(version == VERSION, apply(record, ops, struct, structs, depth)).otherwise(F.raise_error(_unsupported(version)))

    def own(num: int) -> Column:
        return F.filter(ops, lambda o: o["field_num"] == num)

    fields = [_field(record[f.name], own(f.num), f.ref, structs, depth).alias(f.name) for f in struct.fields]
    out = F.when(F.size(ops) <= MAX_OPS, F.struct(*fields)).otherwise(F.raise_error(F.lit("patch has too many ops")))
    return F.when(_strangers(ops, struct) == 0, out).otherwise(F.raise_error(F.lit(UNKNOWN))) if depth else out


UNKNOWN = "patch of a nested struct names an unknown field"


def _unsupported(version: Column) -> Column:
    return F.concat(F.lit("unsupported patch version: "), version.cast("string"))


def _strangers(ops: Column, struct: Struct) -> Column:
    """How many ops name fields that the struct has not."""
    return F.size(F.filter(ops, lambda o: ~o["field_num"].isin([f.num for f in struct.fields])))


def error(record: Column, ops: Column, struct: Struct, structs: dict[str, Struct], version: Column | None = None, depth: int = 0) -> Column:
    """Why ``apply`` refuses ``ops``, "" if it does not: the first of version, number of ops, nested unknown fields, and list places by field.

    Places are held against the list as the ops before have left it.
    """
    checks = []
    if version is not None:
        checks.append(F.when(version != VERSION, _unsupported(version)))
    checks.append(F.when(F.size(ops) > MAX_OPS, "patch has too many ops"))
    if depth:
        checks.append(F.when(_strangers(ops, struct) > 0, UNKNOWN))

    def of(num: int) -> Column:
        return F.filter(ops, lambda o: o["field_num"] == num)

    for f in struct.fields:
        own = of(f.num)
        if f.ref.kind == "struct":
            inner = F.from_json(F.get(F.filter(own, lambda o: o["type"] == STRUCT_PATCH), 0)["value"], f"array<{OP}>")
            checks.append(F.when(inner.isNotNull(), F.nullif(error(record[f.name], inner, structs[f.ref.name], structs, None, depth + 1), F.lit(""))))
        elif f.ref.kind == "list":
            checks.append(F.nullif(_list_error(F.coalesce(F.size(filled(record[f.name], f.ref, structs)), F.lit(0)), own, f.ref, structs), F.lit("")))
    return F.coalesce(*checks, F.lit(""))


def _list_error(length: Column, ops: Column, ref: Ref, structs: dict[str, Struct]) -> Column:
    t = spark_type(ref, structs)
    start = F.struct(length.cast("int").alias("n"), F.lit("").alias("e"))

    def step(a, o):
        i, n, kind = o["index"], a["n"], o["type"]
        out = (i < 0) | (i > n) | ((i == n) & (kind != LIST_INSERT))
        names = {LIST_SET: "set", LIST_INSERT: "insert", LIST_REMOVE: "remove", LIST_STRUCT_PATCH: "struct patch"}
        e = F.lit("")
        for k, name in names.items():
            e = F.when((kind == k) & out, f"{name}: index out of range").otherwise(e)
        if ref.item.kind == "struct":
            known = [f.num for f in structs[ref.item.name].fields]
            strange = F.exists(F.from_json(o["value"], f"array<{OP}>"), lambda x: ~x["field_num"].isin(known))
            e = F.when((e == "") & (kind == LIST_STRUCT_PATCH) & F.coalesce(strange, F.lit(False)), UNKNOWN).otherwise(e)
        after = F.when(kind == LIST_INSERT, n + 1).when(kind == LIST_REMOVE, n - 1).when(kind == CLEAR, 0).when(kind == LIST_REPLACE, F.size(F.from_json(o["value"], t))).otherwise(n)
        return F.when(a["e"] != "", a).otherwise(F.struct(after.cast("int").alias("n"), e.alias("e")))

    return F.aggregate(ops, start, step)["e"]


def _typed(col: Column, t: T.DataType) -> Column:
    return col.cast(t)


def _field(col: Column, ops: Column, ref: Ref, structs: dict[str, Struct], depth: int) -> Column:
    t = spark_type(ref, structs)
    if ref.kind in ("map", "any"):
        return col
    if ref.kind != "list":
        def step(acc, o):
            out = F.when(o["type"] == SET, _parse(o["value"], ref, structs)).when(o["type"] == CLEAR, zero(ref, structs))
            if ref.kind == "struct":
                nested = F.from_json(o["value"], f"array<{OP}>")
                out = out.when(o["type"] == STRUCT_PATCH, apply(acc, nested, structs[ref.name], structs, depth + 1))
            return _typed(out.otherwise(acc), t)

        return F.aggregate(ops, _typed(filled(col, ref, structs), t), step)

    def edit(acc, o):
        i, item = o["index"], _parse(o["value"], ref.item, structs)
        out = F.when(o["type"] == LIST_REPLACE, F.from_json(o["value"], t, {"mode": "FAILFAST"}))
        out = out.when(o["type"] == CLEAR, zero(ref, structs)).when(o["type"] == LIST_SET, arrays.put(acc, i, item))
        out = out.when(o["type"] == LIST_INSERT, F.coalesce(arrays.insert(acc, i, item), F.raise_error(F.lit("insert: index out of range")).cast(t)))
        out = out.when(o["type"] == LIST_REMOVE, F.coalesce(arrays.remove(acc, i), F.raise_error(F.lit("remove: index out of range")).cast(t)))
        if ref.item.kind == "struct":
            nested = F.from_json(o["value"], f"array<{OP}>")
            inside = (i >= 0) & (i < F.size(acc))
            out = out.when((o["type"] == LIST_STRUCT_PATCH) & ~inside, F.raise_error(F.lit("struct patch: index out of range")).cast(t))
            out = out.when(o["type"] == LIST_STRUCT_PATCH, F.transform(acc, lambda x, k: F.when(k == i, apply(x, nested, structs[ref.item.name], structs, depth + 1)).otherwise(x)))
        return _typed(out.otherwise(acc), t)

    return F.aggregate(ops, _typed(filled(col, ref, structs), t), edit)


def op_size(ops: Column, widths: dict[int, int]) -> Column:
    """Encoded bytes of a flat patch: header, version, list header and its ops; ``widths`` by field number, text otherwise."""
    known = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv]) if widths else None

    def one(o):
        n = F.octet_length(o["value"]) if known is None else F.coalesce(F.try_element_at(known, o["field_num"]), F.octet_length(o["value"]))
        n = F.when((o["type"] == CLEAR) | (o["type"] == LIST_REMOVE), F.lit(0)).otherwise(F.coalesce(n, F.lit(0)))
        return (F.lit(8) + F.when(o["field_num"] > 0, 8).otherwise(0) + 8 + F.when(o["index"] != 0, 8).otherwise(0) + F.when(n > 0, n + F.pmod(-n, F.lit(8)) + 8).otherwise(0)).cast("long")

    return F.aggregate(ops, F.when(F.size(ops) > 0, 24).otherwise(16).cast("long"), lambda a, o: a + one(o))
