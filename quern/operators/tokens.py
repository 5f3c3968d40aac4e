"""Records as token streams and back: pre-order, with every field of the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.presence import value as filled
from quern.functions.schema import Enum, Struct
from quern.functions.types import Ref, spark_type

from . import maps
from .enums import name_of, number_of

# Token kinds.
STRUCT_START, STRUCT_END, FIELD, LIST_START, LIST_END, MAP_START, MAP_END, MAP_ENTRY = range(8)


def _token(kind: int, path: Column, type_id: int = 0, text: Column | None = None, nil: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), path.alias("path"), F.lit(type_id).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("value"), (F.lit(False) if nil is None else nil).alias("is_nil"))


def _text(col: Column, ref: Ref, enums: dict[str, Enum]) -> Column:
    if ref.kind == "enum" and ref.name in enums:
        return name_of(col, enums[ref.name])
    return F.base64(col) if ref.scalar == "bytes" else col.cast("string")


def walk(record: Column, struct: Struct, structs: dict[str, Struct], enums: dict[str, Enum] | None = None, path: Column | None = None) -> Column:
    """Array of tokens of ``record``: (kind, path, type, value, is_nil).

    All fields appear, zeros too; an absent struct, list or map is one field
    token with is_nil and no start or end.
    """
    enums = enums or {}
    root = F.lit("") if path is None else path
    parts = [F.array(_token(STRUCT_START, root))]
    for f in struct.fields:
        parts.append(_walk_field(record[f.name], f.ref, F.concat(root, F.lit(f".{f.name}")), structs, enums))
    return F.concat(*parts, F.array(_token(STRUCT_END, root)))


def _walk_field(col: Column, ref: Ref, path: Column, structs: dict, enums: dict) -> Column:
    t = ref.type_id
    if ref.scalar:
        return F.array(_token(FIELD, path, t, _text(filled(col, ref), ref, enums)))
    if ref.kind == "struct":
        return F.when(col.isNull(), F.array(_token(FIELD, path, t, nil=F.lit(True)))).otherwise(F.concat(F.array(_token(FIELD, path, t)), walk(col, structs[ref.name], structs, enums, path)))
    if ref.kind == "any":
        body = F.concat_ws(":", F.lower(F.hex(col["hash"])), F.base64(col["data"]))
        return F.array(_token(FIELD, path, t, body, col.isNull()))
    head = F.array(_token(FIELD, path, t, nil=F.coalesce(F.size(col) <= 0, F.lit(True))))
    if ref.kind == "list":
        def item(x, i):
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            return walk(x, structs[ref.item.name], structs, enums, at) if ref.item.kind == "struct" else F.array(_token(FIELD, at, ref.item.type_id, _text(x, ref.item, enums) if ref.item.scalar else F.base64(x["data"])))

        body = F.concat(F.array(_token(LIST_START, path, t, F.size(col).cast("string"))), F.flatten(F.transform(col, item)), F.array(_token(LIST_END, path, t)))
    else:
        def entry(e, _):
            at = F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}"))
            own = F.array(_token(MAP_ENTRY, at, ref.item.type_id, _text(e["value"], ref.item, enums) if ref.item.scalar else None))
            return F.concat(own, walk(e["value"], structs[ref.item.name], structs, enums, at)) if ref.item.kind == "struct" else own

        body = F.concat(F.array(_token(MAP_START, path, t, F.size(col).cast("string"))), F.flatten(F.transform(maps.entries(col), entry)), F.array(_token(MAP_END, path, t)))
    return F.when(F.size(col) > 0, F.concat(head, body)).otherwise(head)


def tokens(df: DataFrame, key: str, record: Column, struct: Struct, structs: dict, enums: dict | None = None) -> DataFrame:
    """(key, pos, kind, path, type, value, is_nil), one row per token."""
    return df.select(key, F.posexplode(walk(record, struct, structs, enums)).alias("pos", "t")).select(key, "pos", "t.*")


def skip(df: DataFrame, prefix: str) -> DataFrame:
    """Tokens without the subtree at ``prefix``."""
    p = F.col("path")
    return df.where(~((p == prefix) | p.startswith(prefix + ".") | p.startswith(prefix + "[") | p.startswith(prefix + "{")))


def ingest(df: DataFrame, key: str, struct: Struct, enums: dict[str, Enum] | None = None, ignore_unknown: bool = False) -> DataFrame:
    """Records of scalar fields from a token table (key, path, value): (key, record, unknown).

    unknown lists paths that the schema lacks; unless they are ignored, such a
    record is null.  Of several tokens of a path the greatest value counts.
    """
    enums = enums or {}
    known = [f".{f.name}" for f in struct.fields]
    grouped = df.where("value is not null").groupBy(key, "path").agg(F.max("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("m"))
    fields = []
    for f in struct.fields:
        text = F.try_element_at(F.col("m"), F.lit(f".{f.name}"))
        if f.ref.kind == "enum" and f.ref.name in enums:
            col = number_of(text, enums[f.ref.name]).cast(spark_type(f.ref))
        else:
            col = F.unbase64(text) if f.ref.scalar == "bytes" else text.cast(spark_type(f.ref))
        fields.append(filled(col, f.ref).alias(f.name))
    unknown = F.array_sort(F.filter(F.map_keys("m"), lambda p: ~p.isin(known)))
    record = F.struct(*fields)
    return grouped.select(key, (record if ignore_unknown else F.when(F.size(unknown) == 0, record)).alias("record"), unknown.alias("unknown"))
