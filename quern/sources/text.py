"""The human-readable text format: native writer, and a parser kernel."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.presence import value as filled
from quern.functions.schema import Enum, Schema, Struct
from quern.functions.types import Ref, struct_type
from quern.operators import maps
from quern.operators.enums import name_of
from quern.shipping import ship

from .binary import empty


class TextError(ValueError):
    pass


def _quoted(col: Column) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in (('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _value(col: Column, ref: Ref, schema: Schema, numbers: bool, hexed: bool, indent: str, level: int) -> Column:
    inner, outer = indent * (level + 1), indent * level
    if ref.kind == "enum":
        return filled(col, ref).cast("string") if numbers else name_of(filled(col, ref), schema.enums[ref.name])
    if ref.scalar == "bytes":
        return F.concat(F.lit("0x"), F.lower(F.hex(filled(col, ref)))) if hexed else F.concat(F.lit('"'), F.base64(filled(col, ref)), F.lit('"'))
    if ref.scalar == "string":
        return _quoted(filled(col, ref))
    if ref.scalar:
        return filled(col, ref).cast("string")
    if ref.kind == "struct":
        return F.when(col.isNull(), "null").otherwise(F.concat(F.lit("{\n"), _fields(col, schema.structs[ref.name], schema, numbers, hexed, indent, level + 1), F.lit(outer + "}")))
    if ref.kind == "any":
        return F.when(col.isNull(), "null").otherwise(F.concat(F.lit("@any("), F.lower(F.hex(col["hash"])), F.lit(") "), F.lit('"'), F.base64(col["data"]), F.lit('"')))
    if ref.kind == "list":
        items = F.transform(col, lambda x: F.concat(F.lit(inner), _value(x, ref.item, schema, numbers, hexed, indent, level + 1), F.lit(",\n")))
        flat = F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: _value(x, ref.item, schema, numbers, hexed, indent, level)), ", "), F.lit("]"))
        long = F.concat(F.lit("[\n"), F.array_join(items, ""), F.lit(outer + "]"))
        return F.when(F.coalesce(F.size(col) <= 0, F.lit(True)), "null").otherwise(long if ref.item.kind == "struct" else flat)
    pairs = F.transform(maps.entries(col), lambda e: F.concat(F.lit(inner), _value(e["key"], ref.key, schema, numbers, hexed, indent, level), F.lit(": "), _value(e["value"], ref.item, schema, numbers, hexed, indent, level + 1), F.lit(",\n")))
    return F.when(F.coalesce(F.size(col) <= 0, F.lit(True)), "null").otherwise(F.concat(F.lit("@map {\n"), F.array_join(pairs, ""), F.lit(outer + "}")))


def _fields(record: Column, struct: Struct, schema: Schema, numbers: bool, hexed: bool, indent: str, level: int) -> Column:
    return F.concat(*[F.concat(F.lit(f"{indent * level}{f.name}: "), _value(record[f.name], f.ref, schema, numbers, hexed, indent, level), F.lit(",\n")) for f in struct.fields])


def to_text(record: Column, name: str, schema: Schema, numbers: bool = False, hex_bytes: bool = False, indent: str = "    ") -> Column:
    """One ``Name: value,`` line a field; native."""
    return _fields(record, schema.structs[name], schema, numbers, hex_bytes, indent, 0)


_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|("(?:[^"\\]|\\.)*"|`[^`]*`|@map|@any|0[xX][0-9A-Fa-f]*|[A-Za-z_]\w*|[-+]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?(?:inf|Inf|NaN|nan)|[{}\[\]():,])', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f"}


def _lex(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TextError(f"unexpected {text[at : at + 10]!r}")
        if m[1]:
            out.append(m[1])
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, schema: Schema, ignore_unknown: bool):
        self.tokens, self.at, self.schema, self.lenient = _lex(text), 0, schema, ignore_unknown

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise TextError("text ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def want(self, mark: str) -> None:
        if (got := self.next()) != mark:
            raise TextError(f"{mark!r} expected, not {got!r}")

    def record(self, struct: Struct, close: str = "") -> dict:
        refs = {f.name: f.ref for f in struct.fields}
        out = {n: empty(r, self.schema) for n, r in refs.items()}
        while self.peek() != close:
            name = self.next()
            self.want(":")
            if name in refs:
                out[name] = self.value(refs[name])
            elif self.lenient:
                self.skip()
            else:
                raise TextError(f"{struct.name} has no field {name!r}")
            if self.peek() == ",":
                self.next()
            elif self.peek() != close:
                raise TextError(f"',' expected, not {self.peek()!r}")
        if close:
            self.next()
        return out

    def skip(self) -> None:
        depth = 0
        while True:
            t = self.peek()
            if not t or depth == 0 and t in (",", "}", "]"):
                return
            depth += (t in "{[(") - (t in "}])")
            self.next()

    def text(self, t: str) -> str:
        if t[:1] == "`":
            return t[1:-1]
        if t[:1] != '"':
            raise TextError(f"a string expected, not {t!r}")
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), t[1:-1], flags=re.S)

    def value(self, ref: Ref):
        if self.peek() == "null":
            self.next()
            return empty(ref, self.schema)
        if ref.kind == "struct":
            self.want("{")
            return self.record(self.schema.structs[ref.name], "}")
        if ref.kind == "list":
            self.want("[")
            out = []
            while self.peek() != "]":
                out.append(self.value(ref.item))
                if self.peek() == ",":
                    self.next()
            self.next()
            return out
        if ref.kind == "map":
            self.want("@map")
            self.want("{")
            pairs = {}
            while self.peek() != "}":
                key = self.value(ref.key)
                self.want(":")
                pairs[key] = self.value(ref.item)
                if self.peek() == ",":
                    self.next()
            self.next()
            return list(pairs.items())
        t = self.next()
        if ref.kind == "any":
            if t != "@any":
                raise TextError("@any expected")
            self.want("(")
            digest = ""
            while self.peek() != ")":
                digest += self.next()
            self.next()
            return {"hash": bytes.fromhex(digest), "data": base64.b64decode(self.text(self.next()))}
        if ref.kind == "enum" and t in self.schema.enums[ref.name].values:
            return self.schema.enums[ref.name].values[t]
        if ref.scalar == "bool":
            if t not in ("true", "false"):
                raise TextError(f"true or false expected, not {t!r}")
            return t == "true"
        if ref.scalar == "string":
            return self.text(t)
        if ref.scalar == "bytes":
            return bytes.fromhex(t[2:]) if t[:2] in ("0x", "0X") else base64.b64decode(self.text(t), validate=True)
        try:
            return float(t) if ref.scalar[:5] == "float" else int(t, 16) if t[:2] in ("0x", "0X") else int(t)
        except ValueError:
            raise TextError(f"{t!r} is no {ref.scalar}") from None


def parse_text(text: str, name: str, schema: Schema, ignore_unknown: bool = False) -> dict:
    return _Parser(text, schema, ignore_unknown).record(schema.structs[name])


def from_text(df: DataFrame, column: str, schema: Schema, name: str, keep: tuple[str, ...] = (), ignore_unknown: bool = False) -> DataFrame:
    """Columns ``keep`` and the struct's fields parsed from ``column``."""
    ship(df.sparkSession)
    shape = struct_type(schema.structs[name], schema.structs)

    def kernel(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        for batch in batches:
            made = pa.RecordBatch.from_pylist([parse_text(t, name, schema, ignore_unknown) for t in batch[column].to_pylist()], schema=arrow)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], *made.columns], names=[*keep, *made.schema.names])

    return df.select(*keep, column).mapInArrow(kernel, T.StructType([df.schema[k] for k in keep] + shape.fields))


def enum_names(schema: Schema) -> dict[str, Enum]:
    return schema.enums
