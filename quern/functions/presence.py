"""Presence, zero defaults, encoded sizes and headers as native Column expressions.

There is no null: a field that is zero or empty is absent.  Only nested structs
use null for absence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import Struct
from .types import WIDTH, Ref, range_of, spark_type


def zero(ref: Ref, structs: dict | None = None) -> Column:
    t = spark_type(ref, structs)
    if ref.kind in ("struct", "any"):
        return F.lit(None).cast(t)
    if ref.kind == "list":
        return F.array().cast(t)
    if ref.kind == "map":
        return F.create_map().cast(t)
    if ref.scalar == "bool":
        return F.lit(False)
    if ref.scalar == "bytes":
        return F.lit(b"")
    return F.lit("") if ref.scalar == "string" else F.lit(0).cast(t)


def value(col: Column, ref: Ref, structs: dict | None = None) -> Column:
    """The field, or its zero value where it is absent."""
    return col if ref.kind in ("struct", "any") else F.coalesce(col, zero(ref, structs))


def is_set(col: Column, ref: Ref) -> Column:
    """Whether a field is stored: not zero, not empty (-0.0 is zero, NaN is not)."""
    if ref.kind in ("struct", "any"):
        return col.isNotNull()
    if ref.kind in ("list", "map"):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    if ref.scalar == "bool":
        return F.coalesce(col, F.lit(False))
    if ref.scalar in ("string", "bytes"):
        return F.coalesce(F.octet_length(col) > 0, F.lit(False))
    return F.coalesce(col != F.lit(0), F.lit(False))


def mask(record: Column, struct: Struct) -> Column:
    """One character a field, in field order: 1 stored, 0 absent."""
    return F.concat(*[F.when(is_set(record[f.name], f.ref), "1").otherwise("0") for f in struct.fields])


def clear(record: Column, struct: Struct, name: str, structs: dict | None = None) -> Column:
    ref = next(f.ref for f in struct.fields if f.name == name)
    return record.withField(name, zero(ref, structs))


def pad8(n: Column) -> Column:
    return n + F.pmod(-n, F.lit(8))


def _flat_size(col: Column, ref: Ref, structs: dict) -> Column:
    """Bytes of a key or value inside a map."""
    if ref.scalar in ("string", "bytes"):
        return F.octet_length(col) + 4
    if ref.scalar:
        return F.lit(WIDTH[ref.scalar])
    if ref.kind == "struct":
        return record_size(col, structs[ref.name], structs)
    if ref.kind == "any":
        return F.octet_length(col["data"]) + 16
    return field_size(col, ref, structs)


def _sum(arr: Column, of) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda n, x: n + of(x).cast("long"))


def field_size(col: Column, ref: Ref, structs: dict) -> Column:
    """Bytes that a field takes in its record: 0 when absent."""
    if ref.scalar in ("string", "bytes"):
        n = pad8(F.octet_length(col).cast("long")) + 8
    elif ref.scalar:
        n = F.lit(16 if WIDTH[ref.scalar] == 8 else 8)
    elif ref.kind == "struct":
        child = record_size(col, structs[ref.name], structs)
        return F.when(col.isNotNull() & (child > 8), child).otherwise(F.lit(0)).cast("long")
    elif ref.kind == "any":
        n = F.octet_length(col["data"]) + 24
    elif ref.kind == "map":
        n = pad8(_sum(F.map_entries(col), lambda e: _flat_size(e["key"], ref.key, structs) + _flat_size(e["value"], ref.item, structs))) + 8
    elif ref.item.scalar == "bool":
        n = pad8(F.ceil(F.size(col) / 8)) + 8
    elif ref.item.scalar in ("string", "bytes"):
        n = pad8(_sum(col, lambda x: F.octet_length(x) + 4)) + 8
    elif ref.item.scalar:
        n = F.size(col) * WIDTH[ref.item.scalar] + 8
    elif ref.item.kind == "any":
        n = _sum(col, lambda x: F.octet_length(x["data"]) + 16) + 8
    else:
        n = _sum(col, lambda x: record_size(x, structs[ref.item.name], structs)) + 8
    return F.when(is_set(col, ref), n).otherwise(F.lit(0)).cast("long")


def record_size(record: Column, struct: Struct, structs: dict, with_presence_bits: bool = False) -> Column:
    """Bytes of a whole record; the optional presence bits are one byte for seven fields, padded."""
    total = F.lit(8).cast("long")
    for f in struct.fields:
        total = total + field_size(record[f.name], f.ref, structs)
    return total + (-(-max(1, -(-len(struct.fields) // 7)) // 8) * 8 if with_presence_bits else 0)


def field_place(record: Column, struct: Struct, structs: dict, name: str) -> Column:
    """struct(offset, size): where a field lies in its encoded record, (0, 0) if it is absent."""
    offset, size = F.lit(8).cast("long"), None
    for f in struct.fields:
        own = field_size(record[f.name], f.ref, structs)
        if f.name == name:
            size = own
            break
        offset = offset + own
    return F.struct(F.when(size > 0, offset).otherwise(0).cast("long").alias("offset"), size.alias("size"))


def header(num: Column, type_id: Column, payload: Column) -> Column:
    """The 8 header bytes as hex: field number (16 bits), type (8), payload (40), little-endian."""
    word = F.hex(F.shiftleft(payload.cast("long"), 24).bitwiseOR(F.shiftleft(type_id.cast("long"), 16)).bitwiseOR(num.cast("long")))
    word = F.lpad(word, 16, "0")
    return F.concat(*[F.substring(word, i, 2) for i in range(15, 0, -2)])


def little_endian(data: Column, at: int, width: int) -> Column:
    """The unsigned integer of ``width`` (up to 7) bytes of binary ``data`` from 0-based ``at``."""
    h = F.hex(data)
    digits = F.concat(*[F.substring(h, 2 * (at + i) + 1, 2) for i in range(width - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("long")


def put_little_endian(value: Column, scalar: str) -> Column:
    """The bytes of an integer or bool in its wire width; null where the type cannot hold it."""
    width, limits = WIDTH[scalar], range_of(scalar)
    number = value.cast("long") if scalar != "uint64" else value
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    if scalar == "uint64":
        # upper half as what is left of two's complement
        whole = value.cast("decimal(20,0)")
        digits = F.lpad(F.hex(F.when(whole >= F.lit(str(1 << 63)).cast("decimal(20,0)"), whole - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(whole).cast("long")), 16, "0")
    raw = F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 15 - 2 * width, -2)]))
    return F.when(value.between(*[F.lit(str(x)).cast("decimal(20,0)") for x in limits]), raw) if limits else raw


def get_little_endian(data: Column, scalar: str, at: int = 0) -> Column:
    """The integer or bool of its wire width at 0-based ``at``; unsigned ones widen; null if the data is too short."""
    width = WIDTH[scalar]
    h = F.hex(data)
    digits = F.concat(*[F.substring(h, 2 * (at + i) + 1, 2) for i in range(width - 1, -1, -1)])
    number = F.conv(digits, 16, 10).cast("decimal(20,0)")
    limits = range_of(scalar)
    if limits and limits[0] < 0:
        number = F.when(number > limits[1], number - F.lit(str(1 << 8 * width)).cast("decimal(20,0)")).otherwise(number)
    out = number != 0 if scalar == "bool" else number.cast(spark_type(Ref(scalar)))
    return F.when(F.octet_length(data) >= at + width, out)
