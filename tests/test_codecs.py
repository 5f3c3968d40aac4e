"""Golden values, round trips and refusals of the codecs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import presence
from quern.functions.schema import parse
from quern.sources import binary, columnar, compress, framed, json_text, pack, text

ALL = parse("""package all
enum Kind uint8 {
 Plain @0
 Small @1
 Large @2
}
struct Inner {
 Id int64 @0
 Name string @1
}
struct All {
 B bool @0
 I8 int8 @1
 I16 int16 @2
 I32 int32 @3
 I64 int64 @4
 U8 uint8 @5
 U16 uint16 @6
 U32 uint32 @7
 U64 uint64 @8
 F32 float32 @9
 F64 float64 @10
 S string @11
 Raw bytes @12
 In Inner @13
 K Kind @14
 Bs []bool @15
 Ns []int16 @16
 Ss []string @17
 Ins []Inner @18
 M map[string]int32 @19
 Mi map[int32]Inner @20
 Ks []Kind @21
}
""")
STRUCT = ALL.structs["All"]


def empty():
    return {f.name: binary.empty(f.ref, ALL) for f in STRUCT.fields}


def some(rng):
    r = empty()
    word = lambda: "".join(rng.choice("aé\n\"\\b ") for _ in range(rng.randint(0, 9)))
    r |= {"B": rng.random() < 0.5, "I8": rng.randint(-128, 127), "I16": rng.randint(-32768, 32767), "I32": rng.randint(-(2**31), 2**31 - 1), "I64": rng.randint(-(2**63), 2**63 - 1)}
    r |= {"U8": rng.randint(0, 255), "U16": rng.randint(0, 65535), "U32": rng.randint(0, 2**32 - 1), "U64": rng.randint(0, 2**64 - 1), "F32": rng.choice([0.0, 1.5, -2.25]), "F64": rng.choice([0.0, 3.14, -1e300, math.inf])}
    r |= {"S": word(), "Raw": word().encode(), "In": rng.choice([None, {"Id": 3, "Name": word()}]), "K": rng.randint(0, 2), "Bs": [rng.random() < 0.5 for _ in range(rng.randint(0, 19))], "Ns": [rng.randint(-9, 9) for _ in range(rng.randint(0, 5))]}
    r |= {"Ss": [word() + "x" for _ in range(rng.randint(0, 4))], "Ins": [{"Id": i, "Name": word()} for i in range(rng.randint(0, 3))], "M": sorted({word(): rng.randint(-5, 5) for _ in range(rng.randint(0, 4))}.items(), key=lambda x: x[0].encode())}
    r |= {"Mi": sorted({rng.randint(-9, 9): {"Id": 1, "Name": word()} for _ in range(rng.randint(0, 3))}.items()), "Ks": [rng.randint(0, 2) for _ in range(rng.randint(0, 3))]}
    return r


def test_binary_round_trip_and_header():
    rng = random.Random(5)
    for _ in range(300):
        r = some(rng)
        data = binary.encode(r, STRUCT, ALL)
        assert binary.check(data) == len(data)
        assert binary.decode(data, STRUCT, ALL) == r


@pytest.mark.parametrize("items", [["", ""], ["abcdefgh", ""], ["a", "", ""], ["", "abcd"], ["abcd"], [""], ["", "", ""], ["abc", "é", ""]])
def test_empty_items_of_a_list_stay(items):
    for name, own in (("Ss", items),):
        data = binary.encode(empty() | {name: own}, STRUCT, ALL)
        assert binary.decode(data, STRUCT, ALL)[name] == own and len(data) % 8 == 0


def test_a_map_that_reads_as_padding_is_refused():
    s = parse("package m\nstruct M {\n A map[int8]int8 @0\n}\n")
    whole = lambda m: binary.decode(binary.encode({"A": m}, s.structs["M"], s), s.structs["M"], s)["A"]
    assert whole([(0, 0)]) == [(0, 0)] and whole([(-1, 0), (0, 3)]) == [(-1, 0), (0, 3)]
    with pytest.raises(binary.RecordError, match="padding"):
        binary.encode({"A": [(-1, 1), (0, 0)]}, s.structs["M"], s)


def test_batches_equal_single_records():
    """The columnar kernels against the functions of one record, on slices and pruned fields too."""
    from decimal import Decimal

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rng = random.Random(8)
    for fields in (None, {"S", "In.Name", "Ins.Id", "U8", "Ks"}, {"B"}) * 8:
        rows = [some(rng) | {"Ss": [rng.choice(["", "a", "abcd", "éé"]) for _ in range(rng.randint(0, 5))]} for _ in range(rng.randint(0, 9))]
        batch = pa.RecordBatch.from_pylist([r | {"U64": Decimal(r["U64"])} for r in rows], schema=to_arrow_schema(ALL.spark("All")))
        if len(rows) > 3:
            batch, rows = batch.slice(1, len(rows) - 2), rows[1:-1]
        made = columnar.encode(batch, STRUCT, ALL)
        assert made.to_pylist() == [binary.encode(r, STRUCT, ALL) for r in rows]
        shape = to_arrow_schema(binary._pruned(STRUCT, ALL, fields and list(fields)))
        got = pa.RecordBatch.from_arrays(columnar.decode(made, STRUCT, ALL, shape, fields), schema=shape)
        want = [binary.decode(bytes(x), STRUCT, ALL, fields) for x in made.to_pylist()]
        assert got.to_pylist() == pa.RecordBatch.from_pylist([r | ({"U64": Decimal(r["U64"])} if "U64" in r else {}) for r in want], schema=shape).to_pylist()


def test_batches_refuse_what_records_refuse():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(ALL.spark("All"))
    for bad in (b"", b"1234567", binary.head(0, 13, 8), binary.head(0, 14, 16), binary.head(0, 14, 4), binary.head(0, 14, 16) + binary.head(3, 5, 0)):
        with pytest.raises(binary.RecordError):
            columnar.decode(pa.array([bad], pa.binary()), STRUCT, ALL, shape, None)
    rng = random.Random(9)
    for _ in range(400):
        data = bytearray(binary.encode(some(rng), STRUCT, ALL))
        data[rng.randrange(8, len(data))] = rng.randrange(256) if len(data) > 8 else 0
        try:
            columnar.decode(pa.array([bytes(data)], pa.binary()), STRUCT, ALL, shape, None)
        except ValueError:
            pass


def test_binary_zero_is_absent_and_pruning():
    assert binary.encode(empty(), STRUCT, ALL) == binary.head(0, 14, 8)
    r = some(random.Random(1)) | {"In": {"Id": 7, "Name": "x"}}
    assert binary.decode(binary.encode(r, STRUCT, ALL), STRUCT, ALL, {"S", "In.Name"}) == {"S": r["S"], "In": {"Name": "x"}}


def test_binary_unknown_fields_are_skipped():
    small = parse("package s\nstruct All {\n B bool @0\n I8 int8 @1\n}\n")
    r = some(random.Random(2))
    assert binary.decode(binary.encode(r, STRUCT, ALL), small.structs["All"], small) == {"B": r["B"], "I8": r["I8"]}


def test_binary_refusals():
    for bad in (b"", b"1234567", binary.head(0, 13, 8), binary.head(0, 14, 16), binary.head(0, 14, 4)):
        with pytest.raises(binary.RecordError):
            binary.check(bad)
    for name, value in (("U8", 256), ("I8", -129), ("U64", -1)):
        with pytest.raises(binary.RecordError):
            binary.encode(empty() | {name: value}, STRUCT, ALL)


def test_native_size_is_encoded_size(spark):
    rng = random.Random(3)
    rows = [some(rng) for _ in range(40)]
    shape = ALL.spark("All")
    frame = spark.createDataFrame([tuple(tuple(r[f.name].values()) if f.name == "In" and r["In"] else [tuple(x.values()) for x in r[f.name]] if f.name == "Ins" else {k: tuple(v.values()) if isinstance(v, dict) else v for k, v in r[f.name]} if f.name in ("M", "Mi") else __import__("decimal").Decimal(r["U64"]) if f.name == "U64" else r[f.name] for f in STRUCT.fields) for r in rows], shape)
    got = [x[0] for x in frame.select(presence.record_size(F.struct("*"), STRUCT, ALL.structs)).collect()]
    assert got == [len(binary.encode(r, STRUCT, ALL)) for r in rows]
    back = binary.decode_records(binary.encode_records(frame, ALL, "All"), "record", ALL, "All")
    assert [r.S for r in back.collect()] == [r["S"] for r in rows]
    assert back.schema["U64"].dataType.simpleString() == "decimal(20,0)"


def plain_pack(data):
    """The packed form word by word."""
    words, out, i = [data[k : k + 8] for k in range(0, len(data), 8)], b"", 0
    while i < len(words):
        word = words[i]
        tag = sum(1 << k for k in range(8) if word[k])
        out += bytes([tag]) + bytes(x for x in word if x)
        i += 1
        if tag in (0, 255):
            run = []
            while i < len(words) and len(run) < 255 and (not any(words[i]) if tag == 0 else words[i].count(0) < 2):
                run.append(words[i])
                i += 1
            out += bytes([len(run)]) + (b"".join(run) if tag else b"")
    return len(data).to_bytes(8, "little") + len(out).to_bytes(8, "little") + out if data else b""


def test_pack_golden_and_round_trip():
    assert pack.pack(b"") is None and pack.pack(None) is None
    with pytest.raises(pack.PackError):
        pack.pack(b"abc")
    zeros = pack.pack(bytes(8 * 300))
    assert len(zeros) <= 36 and pack.unpack(zeros) == bytes(8 * 300)
    assert pack.pack(bytes([1, 0, 0, 0, 0, 0, 0, 2]))[16:] == bytes([0x81, 1, 2])
    rng = random.Random(4)
    word = lambda: rng.choice([bytes(8), b"\x09" * 8, b"\x05" * 7 + b"\0", bytes(rng.choice([0, 0, 7]) for _ in range(8))])
    for _ in range(120):
        rows = [b"".join(word() * rng.choice([1, 1, 2, 3, 300]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]
        made = pack.pack_all(columnar.of_bytes(rows))
        assert [made.data[a : a + n].tobytes() for a, n in zip(made.start, made.size, strict=True)] == [plain_pack(r) for r in rows]
        back = pack.unpack_all(made)
        assert [back.data[a : a + n].tobytes() for a, n in zip(back.start, back.size, strict=True)] == rows
    for bad in (b"1", zeros[:-1], zeros + b"\0"):
        with pytest.raises(pack.PackError):
            pack.unpack(bad)


def test_batches_go_in_pieces(monkeypatch):
    import pyarrow as pa

    arr = pa.array([b"x" * 100] * 10 + [None, b""])
    assert [len(p) for p in columnar.pieces(arr)] == [12]
    monkeypatch.setattr(columnar, "PIECE", 250)
    assert sum(len(p) for p in columnar.pieces(arr)) == 12 and max(len(p) for p in columnar.pieces(arr)) <= 3
    batch = pa.RecordBatch.from_arrays([arr], ["a"])
    assert pa.Table.from_batches(list(columnar.pieces(batch))).to_pydict() == batch.to_pydict() and not list(columnar.pieces(batch.slice(0, 0)))


def test_pack_columns(spark):
    rows = [(b"\1" + bytes(15),), (b"",), (None,), (b"\7" * 16,)]
    df = spark.createDataFrame(rows, "x binary").select("x", pack.packed(F.col("x")).alias("p"))
    got = df.select("x", "p", pack.unpacked(F.col("p")).alias("u")).collect()
    assert [r.p and bytes(r.p) for r in got] == [plain_pack(rows[0][0]), None, None, plain_pack(rows[3][0])]
    assert [r.u and bytes(r.u) for r in got] == [rows[0][0], None, None, rows[3][0]]


def test_compression_registry(spark):
    with pytest.raises(ValueError):
        compress.codec("lzma")
    compress.register("flip", lambda b: b[::-1], lambda b: b[::-1])
    df = spark.createDataFrame([(b"abc",), (b"",), (None,)], "x binary")
    assert [r[0] and bytes(r[0]) for r in df.select(compress.compressed(F.col("x"), "flip")).collect()] == [b"cba", b"", None]


GARDEN = parse("""package garden
enum Soil uint16 {
 Bare @0
 Loam @1
 Peat @7
}
struct Bed {
 Depth float64 @0
 Soil Soil @1
 Note bytes @2
}
struct Plot {
 Label string @0
 Best Bed @1
 Beds []Bed @2
 Seen []Soil @3
 Dry []bool @4
 Sown int64 @5
}
""")


def plots(spark, numbers=False):
    """An empty plot, one of everything, and one of values that JSON needs escapes for, as JSON."""
    rows = [
        ("", None, [], [], [], 0),
        ("north", (0.5, 7, b"\x00\xff"), [(1.0, 1, b""), (float("nan"), 0, b"z")], [7, 0, 1], [False, True], -3),
        ('a"\\\n', (float("inf"), 0, b""), [], [0], [], 2**62),
    ]
    df = spark.createDataFrame(rows, GARDEN.spark("Plot")).coalesce(1)
    return [r[0] for r in df.select(json_text.to_json(F.struct("*"), GARDEN.structs["Plot"], GARDEN.structs, GARDEN.enums, numbers)).collect()]


def test_json_form(spark):
    bare, full, odd = plots(spark)
    assert bare == '{"Label":"","Best":null,"Beds":null,"Seen":null,"Dry":null,"Sown":0}'
    assert full == '{"Label":"north","Best":{"Depth":0.5,"Soil":"Peat","Note":"AP8="},"Beds":[{"Depth":1.0,"Soil":"Loam","Note":""},{"Depth":null,"Soil":"Bare","Note":"eg=="}],"Seen":["Peat","Bare","Loam"],"Dry":[false,true],"Sown":-3}'
    assert odd == '{"Label":"a\\"\\\\\\n","Best":{"Depth":null,"Soil":"Bare","Note":""},"Beds":null,"Seen":["Bare"],"Dry":null,"Sown":4611686018427387904}'
    assert plots(spark, numbers=True)[1] == full.replace('"Peat"', "7").replace('"Loam"', "1").replace('"Bare"', "0")


def test_json_unknown_fields(spark):
    df = spark.createDataFrame([('{"Soil":"Peat","Depth":2.5,"Worms":1}',)], "j string")
    s = GARDEN.structs["Bed"]
    assert tuple(df.select(json_text.from_json(F.col("j"), s, GARDEN.structs, GARDEN.enums, True).alias("r")).first().r) == (2.5, 7, b"")
    with pytest.raises(Exception, match="Worms"):
        df.select(json_text.from_json(F.col("j"), s, GARDEN.structs, GARDEN.enums)).collect()


def test_text_form_and_parse(spark):
    beds = lambda numbers: [r[0] for r in spark.createDataFrame([(0.5, 7, b"\x0a\xff"), (0.0, 0, b"")], GARDEN.spark("Bed")).coalesce(1).select(text.to_text(F.struct("*"), "Bed", GARDEN, numbers)).collect()]
    named, numbered = beds(False), beds(True)
    assert [x.replace("Soil: Peat", "Soil: 7").replace("Soil: Bare", "Soil: 0") for x in named] == numbered and "Soil: Peat,\n" in named[0]
    back = text.from_text(spark.createDataFrame([(x,) for x in named], "t string"), "t", GARDEN, "Bed").collect()
    assert [(r.Depth, r.Soil, bytes(r.Note)) for r in back] == [(0.5, 7, b"\x0a\xff"), (0.0, 0, b"")]
    source = 'S: "a\\"b", // note\nRaw: 0xff00, /* more\n */ U16: 0xFF, F64: -1.5e3, B: true, Ss: ["x", `y\nz`], M: @map { "k": 1, "l": -2, }, In: { Id: 4, Name: "n" }, K: Large, Bs: null'
    r = text.parse_text(source, "All", ALL)
    assert (r["S"], r["Raw"], r["U16"], r["F64"], r["B"], r["Ss"], r["M"], r["In"], r["K"], r["Bs"]) == ('a"b', b"\xff\0", 255, -1500.0, True, ["x", "y\nz"], [("k", 1), ("l", -2)], {"Id": 4, "Name": "n"}, 2, [])
    for bad in ("X: 1", "B: yes", "S: 1", "I8: x", 'S "a"', "In: {", "B: true U8: 1"):
        with pytest.raises(text.TextError):
            text.parse_text(bad, "All", ALL)
    assert text.parse_text("X: { a: [1] }, B: true", "All", ALL, ignore_unknown=True)["B"]


def test_text_quotes_round_trip(spark):
    rows = [('a"b\\c\nd\te é',), ("",)]
    s = parse("package q\nstruct Q {\n S string @0\n}\n")
    written = spark.createDataFrame(rows, s.spark("Q")).select(text.to_text(F.struct("*"), "Q", s).alias("t"))
    assert [tuple(r) for r in text.from_text(written, "t", s, "Q").collect()] == rows


def test_framed_files(spark, tmp_path):
    rng = random.Random(6)
    records = [binary.encode(some(rng), STRUCT, ALL) for _ in range(20)]
    (tmp_path / "one.records").write_bytes(b"".join(records))
    got = framed.read_framed(spark, str(tmp_path)).orderBy("offset").collect()
    assert [bytes(r.record) for r in got] == records
    with pytest.raises(binary.RecordError):
        list(framed.split(b"".join(records)[:-1]))
