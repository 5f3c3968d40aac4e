import hashlib

import pytest

from quern.functions.schema import Registry, SchemaError, import_order, parse, type_hash, version
from quern.functions.types import Ref, range_of

DIRT = parse("package dirt\nenum Soil uint16 {\n Bare @0\n Peat @300\n}\nstruct Probe {\n Acid float32 @0\n}\n")
PLOT = """
// beds and their rows
package plot
OPTIONS [ IsSet() ]
import (
    earth "example.org/field/dirt"
)

struct Row {
    Sown map[int16]Stock @1
    Beds []Bed @2
    Long float32 @0
}
enum Stock uint8 {
    None @0
    Beans @9
}
struct Bed {
    Rows []Row @4
    Near []Bed @2
    Soil earth.Soil @0
    Found Any @3 // whatever was dug up
    Probes []earth.Probe @1
}
"""


def plot():
    return parse(PLOT, {"earth": DIRT})


def test_fields_are_sorted_and_typed():
    found = plot()
    assert {name: [(f.name, f.ref.type_id) for f in s.fields] for name, s in found.structs.items()} == {
        "Row": [("Long", 10), ("Sown", 55), ("Beds", 54)],
        "Bed": [("Soil", 7), ("Probes", 54), ("Near", 54), ("Found", 15), ("Rows", 54)],
        "earth.Probe": [("Acid", 10)],
    }
    assert found.imports == {"earth": "example.org/field/dirt"} and found.enums["Stock"].by_value() == [("None", 0), ("Beans", 9)]


def test_structs_inside_each_other_end_in_bytes():
    row = plot().spark("Bed", 1)["Rows"].dataType.elementType
    again = row["Beds"].dataType.elementType
    assert again["Rows"].dataType.elementType.simpleString() == again["Near"].dataType.elementType.simpleString() == "binary"
    assert row["Sown"].metadata == {"num": 1} and row["Sown"].dataType.simpleString() == "map<smallint,smallint>"


@pytest.mark.parametrize(
    "text",
    [
        "enum A uint8 {\n}", "package Cars", "package a\nversion 1", "package a\noptions [ Other() ]", "package a\nstruct A {\n}", "package a\nstruct A {\n X int8 @1\n}",
        "package a\nstruct A {\n X int8 @0\n Y int8 @0\n}", "package a\nstruct A {\n x int8 @0\n}", "package a\nstruct A {\n X_Y int8 @0\n}", "package a\nstruct A {\n X Nope @0\n}",
        "package a\nenum A uint8 {\n X @1\n}", "package a\nenum A uint8 {\n X @0\n Y @256\n}", "package a\nenum A int8 {\n X @0\n}", "package a\nstruct A {\n X [][]int8 @0\n}",
        "package a\nstruct A {\n X map[bytes]int8 @0\n}", 'package a\nimport (\n "b/c"\n)', "package a\nstruct A {\n X int8 @0 [jsonName(x)]\n}", "package a\nstruct A {\n X int8 @0",
    ],
)
def test_bad_schemas_are_refused(text):
    with pytest.raises(SchemaError):
        parse(text)


def test_catalog(spark):
    rows = {(r.struct, r.field_name): r for r in plot().catalog(spark).collect()}
    assert len(rows) == 9 and rows["Bed", "Soil"].enum_group == "Soil" and [k for k, r in rows.items() if r.self_ref] == [("Bed", "Near")]
    assert (rows["Row", "Sown"].key_type, rows["Row", "Sown"].value_type) == (3, 6)


def test_identity_order_version():
    assert type_hash("a/b", "C") == hashlib.shake_128(b"a/b.C").digest(16)
    assert import_order({"a": ["b"], "b": ["c"]}) == ["c", "b", "a"]
    with pytest.raises(SchemaError, match="a -> b -> a"):
        import_order({"a": ["b"], "b": ["a"]})
    assert version("v1.20.3") == (1, 20, 3)
    with pytest.raises(SchemaError):
        version("1.2")
    r = Registry()
    r.register("x", DIRT)
    with pytest.raises(SchemaError):
        r.register("x", DIRT)
    assert r.lookup(b"0" * 16) is None


def test_numbers():
    assert range_of("uint8") == (0, 255) and range_of("int16") == (-32768, 32767) and range_of("float32") is None
    assert Ref("list", item=Ref("uint64")).type_id == 49 and Ref("list", item=Ref("string")).type_id == 53


def test_modules(spark):
    from pyspark.sql import functions as F

    from quern.functions.modules import not_imported, parse_module, version_column

    m = parse_module("module a.org/x\nrequire (\n a.org/y v1.2.3 // pinned\n)\nreplace (\n b.org/z => a.org/z\n)\nacls (\n a.org/v/*\n c.org/w\n)\n")
    assert m.require == {"a.org/y": (1, 2, 3)} and m.resolve("b.org/z") == "a.org/z" and m.resolve("q") == "q"
    assert m.allows("a.org/v/deep/er") and m.allows("c.org/w") and not m.allows("c.org/w/x") and not m.allows("a.org/v")
    assert parse_module("acls = public").allows("anyone")
    for bad in ("require (\n a\n)", "replace (\n a -> b\n)", "acls (\n)", "acls (\n a\n", "what", "acls (\n a/*/b\n)", "require (\n a v1.0.0\n a v1.0.1\n)"):
        with pytest.raises(SchemaError):
            parse_module(bad)
    pins = spark.createDataFrame([("a", "v1.10.0"), ("b", "v1.9.0"), ("c", "x")], "path string, v string")
    assert [r.path for r in not_imported(pins, pins.where("path <> 'b'")).collect()] == ["b"]
    assert pins.where("v <> 'x'").orderBy(F.desc(version_column("v"))).first().path == "a" and pins.where(version_column("v").isNull()).count() == 1
