"""Polymorphic values: a 16-byte type hash and the encoded struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(digest: bytes, data: Column) -> Column:
    if len(digest) != 16:
        raise ValueError("a type hash has 16 bytes")
    return F.struct(F.lit(digest).alias("hash"), data.alias("data"))


def unpack(value: Column, digest: bytes, strict: bool = True) -> Column:
    """The data if the hash is ``digest``; else an error, or null."""
    other = F.raise_error(F.lit("value is of another type")) if strict else F.lit(None)
    return F.when(value["hash"] == F.lit(digest), value["data"]).otherwise(other)


def type_of(value: Column, known: dict[bytes, str]) -> Column:
    """The registered name of the value's type, "" if it is unknown."""
    out = F.lit("")
    for digest, name in known.items():
        out = F.when(value["hash"] == F.lit(digest), name).otherwise(out)
    return out


def to_json(value: Column, known: dict[bytes, tuple[str, object]]) -> Column:
    """JSON of a value: known types by their decoder (data -> struct), others as base64 that can be passed on."""
    out = F.to_json(F.struct(F.lower(F.hex(value["hash"])).alias("@type"), F.base64(value["data"]).alias("@value")))
    for digest, (name, decode) in known.items():
        body = F.to_json(decode(value["data"]), {"ignoreNullFields": "false"})
        out = F.when(value["hash"] == F.lit(digest), F.concat(F.lit(f'{{"@type":"{digest.hex()}","@fieldType":"{name}",'), F.substring(body, 2, 1 << 30))).otherwise(out)
    return out


def list_length(values: Column) -> Column:
    """Items of a list of polymorphic values, 0 for null."""
    return F.coalesce(F.when(values.isNotNull(), F.size(values)), F.lit(0))


def list_get_raw(values: Column, index) -> Column:
    """The item (hash, data) at 0-based ``index``, null where there is none."""
    index = index if isinstance(index, Column) else F.lit(index)
    return F.when(index >= 0, F.get(values, index))


def list_get_error(values: Column, index, digest: bytes) -> Column:
    """Why ``list_get`` fails: "not set", "type mismatch" or ""."""
    item = list_get_raw(values, index)
    return F.when(item.isNull(), "not set").when(item["hash"] != F.lit(digest), "type mismatch").otherwise("")


def list_get(values: Column, index, digest: bytes) -> Column:
    """The data at ``index`` if it is of the type ``digest``; a missing item or another type fails the query."""
    e = list_get_error(values, index, digest)
    return F.when(e == "", list_get_raw(values, index)["data"]).otherwise(F.raise_error(e))


def list_set(*items: Column) -> Column:
    """A list of polymorphic values; null items are refused."""
    made = F.array(*items)
    return F.when(F.exists(made, lambda x: x.isNull()), F.raise_error(F.lit("a list of Any has no null items"))).otherwise(made)
