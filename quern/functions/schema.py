"""The schema language: text to checked structs and enums, Spark types, a catalog, type hashes and import order."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .types import SCALARS, Ref, struct_type

KEYS = {k for k in SCALARS if k != "bytes"}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    num: int
    ref: Ref


@dataclass
class Struct:
    name: str
    fields: list[Field]


@dataclass
class Enum:
    name: str
    width: str
    values: dict[str, int]

    @property
    def names(self) -> dict[int, str]:
        return {v: k for k, v in self.values.items()}

    def by_value(self) -> list[tuple[str, int]]:
        return sorted(self.values.items(), key=lambda x: x[1])

    def by_name(self) -> list[tuple[str, int]]:
        return sorted(self.values.items())


@dataclass
class Schema:
    package: str
    version: int = 0
    options: list[str] = field(default_factory=list)
    imports: dict[str, str] = field(default_factory=dict)
    enums: dict[str, Enum] = field(default_factory=dict)
    structs: dict[str, Struct] = field(default_factory=dict)

    def spark(self, name: str, depth: int = 3) -> T.StructType:
        return struct_type(self.structs[name], self.structs, depth)

    def catalog(self, spark: SparkSession) -> DataFrame:
        """One row per field: what reflection over the package shows."""
        rows = []
        for s in self.structs.values():
            for f in s.fields:
                inner = f.ref.item or f.ref
                enum = inner if inner.kind == "enum" else f.ref
                rows.append((self.package, s.name, f.num, f.name, f.ref.type_id, enum.kind == "enum", enum.name if enum.kind == "enum" else "", f.ref.key.type_id if f.ref.key else 0, f.ref.item.type_id if f.ref.kind == "map" else 0, inner.kind == "struct" and inner.name == s.name))
        return spark.createDataFrame(rows, "package string, struct string, field_num int, field_name string, type_id int, is_enum boolean, enum_group string, key_type int, value_type int, self_ref boolean")


def type_hash(path: str, name: str) -> bytes:
    """16 bytes that identify a struct wherever it is declared."""
    return hashlib.shake_128(f"{path}.{name}".encode()).digest(16)


_IDENT = re.compile(r"[A-Z][A-Za-z0-9]*\Z")
_PACKAGE = re.compile(r"[a-z][A-Za-z0-9_]*\Z")
_LINE = re.compile(r"(\S+)\s+(\S+)\s+@(\d+)\Z")


def _lines(text: str):
    for number, raw in enumerate(text.split("\n"), 1):
        line = re.sub(r"(^|\s)//(\s.*|$)", "", raw).strip()
        if line:
            yield number, line


def parse(text: str, imported: dict[str, Schema] | None = None) -> Schema:
    """Check and read one schema file; ``imported`` holds parsed packages by local name.

    Keywords are case-insensitive; every entry stands on one line; names begin
    with a capital; fields are numbered 0..n-1 without gap in any order; enums
    have a value 0; version is 0; types may be used before they are declared.
    """
    lines = list(_lines(text))
    at = 0
    if not lines or not lines[0][1].lower().startswith("package "):
        raise SchemaError("line 1: the package comes first")
    out = Schema(lines[0][1].split(None, 1)[1].strip())
    if not _PACKAGE.match(out.package):
        raise SchemaError(f"bad package name {out.package!r}")
    raw: dict[str, list[tuple[str, str, int, int]]] = {}
    at = 1

    def block(close: str):
        nonlocal at
        at += 1
        while True:
            if at >= len(lines):
                raise SchemaError("block is not closed")
            number, line = lines[at]
            at += 1
            if line == close:
                return
            yield number, line

    while at < len(lines):
        number, line = lines[at]
        words = line.split()
        key = words[0].lower()
        if key == "version":
            if len(words) != 2 or words[1] != "0":
                raise SchemaError(f"line {number}: version {line[7:].strip()!r} is not known")
            at += 1
        elif key.startswith("options"):
            if "[" in line and line.endswith("]"):
                out.options += re.findall(r"[A-Za-z]+\([^)]*\)", line)
                at += 1
            else:
                out.options += [x for _, x in block("]" if "[" in line else ")")]
            for option in out.options:
                if option != "IsSet()":
                    raise SchemaError(f"line {number}: option {option!r} is not known")
        elif key.startswith("import"):
            for n, entry in block(")"):
                m = re.match(r'(?:([a-z]\w*)\s+)?"([^"]+)"\Z', entry)
                if not m:
                    raise SchemaError(f"line {n}: bad import {entry!r}")
                local = m[1] or m[2].rsplit("/", 1)[-1]
                if local in out.imports:
                    raise SchemaError(f"line {n}: {local} is imported twice")
                out.imports[local] = m[2]
        elif key == "enum":
            if len(words) != 4 or words[3] != "{" or words[2] not in ("uint8", "uint16"):
                raise SchemaError(f"line {number}: bad enum {line!r}")
            enum = Enum(_named(words[1], number), words[2], {})
            for n, entry in block("}"):
                m = re.match(r"(\S+)\s+@(\d+)\Z", entry)
                if not m:
                    raise SchemaError(f"line {n}: bad enum value {entry!r}")
                value = int(m[2])
                if m[1] in enum.values or value in enum.names or value >= 2 ** (8 if enum.width == "uint8" else 16):
                    raise SchemaError(f"line {n}: {entry!r} repeats a name or number, or is too large")
                enum.values[_named(m[1], n)] = value
            if 0 not in enum.names:
                raise SchemaError(f"line {number}: an enum needs a value 0")
            _fresh(out, raw, enum.name, number)
            out.enums[enum.name] = enum
        elif key == "struct":
            if len(words) != 3 or words[2] != "{":
                raise SchemaError(f"line {number}: bad struct {line!r}")
            name = _named(words[1], number)
            _fresh(out, raw, name, number)
            raw[name] = []
            for n, entry in block("}"):
                m = _LINE.match(entry)
                if not m:
                    raise SchemaError(f"line {n}: bad field {entry!r}")
                raw[name].append((_named(m[1], n), m[2], int(m[3]), n))
            nums = sorted(x[2] for x in raw[name])
            if not nums or nums != list(range(len(nums))) or len({x[0] for x in raw[name]}) < len(nums) or nums[-1] > 65535:
                raise SchemaError(f"line {number}: fields of {name} need distinct names and the numbers 0 to {len(nums) - 1}")
        else:
            raise SchemaError(f"line {number}: {line!r} is not expected here")
    used: set[str] = set()
    for name, entries in raw.items():
        out.structs[name] = Struct(name, sorted((Field(f, num, _ref(t, out, raw, imported or {}, used, n)) for f, t, num, n in entries), key=lambda x: x.num))
    if unused := set(out.imports) - used:
        raise SchemaError(f"imports {sorted(unused)} are not used")
    for local in used:
        # foreign structs are known by their qualified name
        out.structs |= {f"{local}.{s.name}": replace(s) for s in imported[local].structs.values() if "." not in s.name}
    return out


def _named(name: str, number: int) -> str:
    if not _IDENT.match(name):
        raise SchemaError(f"line {number}: bad name {name!r}")
    return name


def _fresh(out: Schema, raw: dict, name: str, number: int) -> None:
    if name in out.enums or name in raw:
        raise SchemaError(f"line {number}: {name} is declared twice")


def _ref(text: str, out: Schema, raw: dict, imported: dict[str, Schema], used: set[str], number: int) -> Ref:
    if text in SCALARS:
        return Ref(text)
    if text == "Any":
        return Ref("any")
    if text.startswith("[]"):
        item = _ref(text[2:], out, raw, imported, used, number)
        if item.kind in ("list", "map"):
            raise SchemaError(f"line {number}: a list cannot hold {text[2:]}")
        return Ref("list", item=item)
    if m := re.match(r"map\[(\w+)\](.+)\Z", text):
        if m[1] not in KEYS:
            raise SchemaError(f"line {number}: {m[1]} cannot be a key")
        return Ref("map", key=Ref(m[1]), item=_ref(m[2], out, raw, imported, used, number))
    local, _, name = text.rpartition(".")
    if local:
        if local not in out.imports or local not in imported:
            raise SchemaError(f"line {number}: {local} is not imported")
        used.add(local)
        if name in imported[local].enums:
            return Ref("enum", name, width=imported[local].enums[name].width)
        if name in imported[local].structs:
            return Ref("struct", text)
    elif text in out.enums:
        return Ref("enum", text, width=out.enums[text].width)
    elif text in raw:
        return Ref("struct", text)
    raise SchemaError(f"line {number}: type {text!r} is not known")


def import_order(graph: dict[str, list[str]]) -> list[str]:
    """Packages with their imports first; SchemaError names the loop if there is one."""
    done: list[str] = []

    def visit(node: str, path: tuple[str, ...]) -> None:
        if node in path:
            raise SchemaError("import loop: " + " -> ".join([*path[path.index(node) :], node]))
        if node not in done:
            for x in sorted(graph.get(node, [])):
                visit(x, (*path, node))
            done.append(node)

    for name in sorted(graph):
        visit(name, ())
    return done


def version(text: str) -> tuple[int, int, int]:
    m = re.match(r"v(\d+)\.(\d+)\.(\d+)\Z", text)
    if not m:
        raise SchemaError(f"bad version {text!r}")
    return tuple(map(int, m.groups()))


class Registry:
    """Packages by path and structs by type hash; a path registers once, the first struct of a hash stays."""

    def __init__(self):
        self.packages: dict[str, Schema] = {}
        self.hashes: dict[bytes, tuple[str, str]] = {}

    def register(self, path: str, schema: Schema) -> None:
        if path in self.packages:
            raise SchemaError(f"{path} is registered already")
        self.packages[path] = schema
        for name in schema.structs:
            self.hashes.setdefault(type_hash(path, name), (path, name))

    def lookup(self, digest: bytes) -> tuple[str, str] | None:
        return self.hashes.get(digest)
