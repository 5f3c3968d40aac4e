"""Golden cases of lists, maps, diff, patch, routing and streams."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions.schema import parse
from quern.functions.types import Ref
from quern.functions import presence
from quern.operators import anys, arrays, bits, diff, enums, maps, patch, routing
from quern.streaming import frames

P = parse("""package p
struct Leaf {
 Name string @0
 Sizes []int32 @1
}
struct Rec {
 Count uint16 @0
 Ratio float64 @1
 Flags []bool @2
 Title string @3
 Raw bytes @4
 Leaf Leaf @5
 Leaves []Leaf @6
}
struct WithMap {
 M map[string]int32 @0
}
""")
S = P.structs


def pair(spark, old, new):
    zero = {"Count": 0, "Ratio": 0.0, "Flags": [], "Title": "", "Raw": b"", "Leaf": None, "Leaves": []}
    t = P.spark("Rec")
    rows = [(tuple((zero | old).values()), tuple((zero | new).values()))]
    df = spark.createDataFrame(rows, f"old {t.simpleString()}, new {t.simpleString()}")
    return df.withColumn("ops", diff.diff(F.col("old"), F.col("new"), S["Rec"], S))


def kinds(spark, old, new):
    df = pair(spark, old, new)
    row = df.select("ops", patch.apply(F.col("old"), F.col("ops"), S["Rec"], S).eqNullSafe(F.col("new")).alias("same")).first()
    assert row.same
    return [(o["type"], o["index"]) for o in row.ops]


def plain_list_ops(old, new):
    """(type, place) of positional edits, or of one replacement if they outnumber half of both lengths."""
    n, m = len(old), len(new)
    ops = [(5, i) for i in range(min(n, m)) if old[i] != new[i]] + [(6, i) for i in range(n, m)] + [(7, i) for i in reversed(range(m, n))]
    return [(4, -1)] if len(ops) > (n + m) // 2 else ops


def test_list_ops_follow_the_rule(spark):
    rng = random.Random(12)
    flags = lambda: [rng.random() < 0.6 for _ in range(rng.randint(0, 6))]
    zero = {"Count": 0, "Ratio": 0.0, "Flags": [], "Title": "", "Raw": b"", "Leaf": None, "Leaves": []}
    pairs = [(flags(), flags()) for _ in range(150)]
    t = P.spark("Rec").simpleString()
    df = spark.createDataFrame([(k, *(tuple((zero | {"Flags": x}).values()) for x in p)) for k, p in enumerate(pairs)], f"k int, old {t}, new {t}")
    got = df.select("k", diff.diff(F.col("old"), F.col("new"), S["Rec"], S).alias("ops")).collect()
    assert {r.k: [(o["type"], o["index"]) for o in r.ops] for r in got} == {k: plain_list_ops(*p) for k, p in enumerate(pairs)}


def test_ops_of_other_fields(spark):
    nan = float("nan")
    whole = {"Count": 40, "Ratio": 0.25, "Title": "moss", "Raw": b"\x01\x02", "Leaf": ("fern", [7]), "Leaves": [("ivy", []), ("oak", [3])]}
    assert kinds(spark, whole, whole) == [] == kinds(spark, {"Ratio": nan}, {"Ratio": nan}) == kinds(spark, {"Ratio": -0.0}, {"Ratio": 0.0})
    # numbers are set, also to zero; empty text and bytes are cleared
    assert kinds(spark, whole, whole | {"Count": 0, "Ratio": nan}) == [(1, -1), (1, -1)]
    assert kinds(spark, whole, whole | {"Title": "", "Raw": b""}) == [(2, -1), (2, -1)]
    # a struct is set where there was none, cleared, or patched
    assert [kinds(spark, {"Leaf": a}, {"Leaf": b}) for a, b in ((None, ("fern", [])), (("fern", []), None), (("fern", []), ("fir", [9, 9, 9])))] == [[(1, -1)], [(2, -1)], [(3, -1)]]
    # items of a struct list are patched in place
    assert kinds(spark, whole, whole | {"Leaves": [("ivy", []), ("oak", [3, 4])]}) == [(8, 1)] and kinds(spark, {}, {"Leaves": [("ivy", [])]}) == [(4, -1)]


def test_apply_of_diff_is_target(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice('ab"é\\') for _ in range(rng.randint(0, 4)))
    leaf = lambda: (word(), [rng.randint(0, 3) for _ in range(rng.randint(0, 4))])
    rec = lambda: (rng.randint(0, 2), rng.choice([0.0, 1.5, -2.0]), [rng.random() < 0.5 for _ in range(rng.randint(0, 5))], word(), word().encode(), rng.choice([None, leaf()]), [leaf() for _ in range(rng.randint(0, 4))])
    t = P.spark("Rec").simpleString()
    df = spark.createDataFrame([(rec(), rec()) for _ in range(120)], f"old {t}, new {t}")
    made = df.select("old", "new", diff.diff(F.col("old"), F.col("new"), S["Rec"], S).alias("ops")).select("new", patch.apply(F.col("old"), F.col("ops"), S["Rec"], S).alias("made"))
    assert made.where(~F.col("made").eqNullSafe(F.col("new"))).count() == 0


def test_maps_have_no_patch_and_unknown_ops_are_skipped(spark):
    with pytest.raises(diff.NotPatchable):
        diff.diff(F.col("a"), F.col("b"), S["WithMap"], S)
    df = pair(spark, {"Count": 5}, {"Count": 6})
    odd = F.array(diff.op(0, 99, -1, F.lit("7")), diff.op(77, 1, -1, F.lit("7")))
    assert df.select(patch.apply(F.col("old"), odd, S["Rec"], S).alias("r")).first().r.Count == 5


def test_list_edges(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "q array<int>")
    got = df.select(arrays.insert(F.col("q"), 3, 9).alias("i"), arrays.remove(F.col("q"), 0).alias("r"), arrays.between(F.col("q"), -5, 2).alias("b"), arrays.between(F.col("q"), 2, 1).alias("n")).collect()
    assert [tuple(r) for r in got] == [([1, 2, 3, 9], [2, 3], [1, 2], []), (None, None, [], [])]
    for bad in (arrays.get(F.col("q"), 3), arrays.put(F.col("q"), -1, 0)):
        with pytest.raises(Exception, match="out of range"):
            df.select(bad).collect()


def test_maps_and_metadata(spark):
    df = spark.sql("select map(2, 'b', 1, 'a') m, array(struct('A' key, 'x' value), struct('b' key, 'y' value), struct('a' key, 'z' value)) p")
    r = df.select(maps.keys(F.col("m")).alias("k"), maps.values(maps.put(F.col("m"), 1, "c")).alias("v"), maps.metadata(F.col("p")).alias("md"), maps.get(F.col("m"), 7).alias("g")).first()
    assert (r.k, r.v, r.md, r.g) == ([1, 2], ["c", "b"], {"b": "y", "a": "z"}, None)


def test_any_and_enum(spark):
    df = spark.range(1).select(anys.pack(b"0" * 16, F.lit(b"abc")).alias("v"))
    assert bytes(df.select(anys.unpack(F.col("v"), b"0" * 16)).first()[0]) == b"abc"
    with pytest.raises(Exception, match="another type"):
        df.select(anys.unpack(F.col("v"), b"1" * 16)).collect()
    with pytest.raises(ValueError):
        anys.pack(b"short", F.lit(b""))
    e = parse("package e\nenum E uint8 {\n Zero @0\n Two @2\n}\n").enums["E"]
    row = spark.range(1).select(enums.name_of(F.lit(2), e), enums.name_of(F.lit(1), e), enums.number_of(F.lit("Two"), e), enums.number_of(F.lit("x"), e)).first()
    assert tuple(row) == ("Two", "", 2, 0)
    with pytest.raises(Exception, match="no number 1"):
        spark.range(1).select(enums.name_of(F.lit(1), e, strict=True)).collect()


def test_presence(spark):
    df = spark.createDataFrame([(-0.0, float("nan"))], "a double, b double")
    assert tuple(df.select(presence.is_set(F.col("a"), Ref("float64")), presence.is_set(F.col("b"), Ref("float64"))).first()) == (False, True)


def test_bits(spark):
    assert bits.mask(1, 3) == 6
    assert spark.range(1).select(bits.set_value(F.lit(0xFF), F.lit(0), 2, 4)).first()[0] == 0xF3


def test_weighted_and_round_robin(spark):
    calls = spark.range(600).select(F.col("id").alias("k"), F.lit("g").alias("g"))
    targets = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 3)], "g string, t string, w int")
    assert {r.t: r["count"] for r in routing.weighted(calls, targets, "k", "g", "t", "w").groupBy("t").count().collect()} == {"a": 100, "b": 200, "c": 300}


def test_service_config(spark):
    rules = spark.createDataFrame([("*/*/*", 30), ("myapp/*/*", 20), ("myapp/UserService/*", 10), ("myapp/UserService/Get", 5)], "pattern string, timeout int")
    calls = spark.createDataFrame([("myapp", "UserService", "Get"), ("myapp", "UserService", "Put"), ("myapp", "X", "Y"), ("o", "X", "Y")], "package string, service string, call string")
    assert sorted(r.timeout for r in routing.match_config(calls, rules).collect()) == [5, 10, 20, 30]


def test_lcg_matches_machine_arithmetic(spark):
    rows = spark.createDataFrame([(x, n) for x in (1, 2, 12345, 2**62) for n in (2, 7)], "s long, n long").select("s", "n", routing.lcg_pick(F.col("s"), F.col("n")).alias("p")).collect()
    assert all(r.p == (r.s * routing.LCG_A + routing.LCG_C) % 2**64 % r.n for r in rows)


def test_retry_counts_first_call(spark):
    assert spark.range(1).select(routing.retry_schedule(F.lit(10), 2.0, F.lit(50), 4)).first()[0] == [10.0, 20.0, 40.0, 50.0]


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.5",), ("10.0.1.5",), ("x",), ("10.0.0.999",), (None,)], "ip string")
    assert [r[0] for r in df.select(routing.in_networks(F.col("ip"), ["10.0.0.0/24"])).collect()] == [True, False, False, False, False]


def test_reassembly_and_sessions(spark):
    rows = spark.createDataFrame([(1, 2, "b", False), (1, 1, "a", False), (1, 3, "", True), (1, 4, "late", False), (2, 1, "z", True)], "s int, q int, p string, e boolean")
    assert sorted(map(tuple, frames.reassemble(rows, "s", "q", "p", "e").collect())) == [(1, 2, "ab"), (2, 1, "z")]


def test_chain_is_outermost_first(spark):
    df = routing.chain(spark.range(1), lambda d: d.withColumn("x", F.concat("x", F.lit("1"))), lambda d: d.withColumn("x", F.lit("2")))
    assert df.first().x == "21"


def test_patch_refusals(spark):
    """What ``error`` names, ``apply`` refuses; unknown fields of the record itself are skipped."""
    df = pair(spark, {"Leaf": ("a", [1]), "Leaves": [("x", []), ("y", [])]}, {})
    nested = lambda num: F.to_json(F.array(diff.op(num, diff.SET, -1, F.lit("v"))))
    cases = [
        (F.array(diff.op(6, diff.LIST_STRUCT_PATCH, 1, nested(0))), ""),
        (F.array(diff.op(6, diff.LIST_STRUCT_PATCH, 2, nested(0))), "struct patch: index out of range"),
        (F.array(diff.op(6, diff.LIST_STRUCT_PATCH, -1, nested(0))), "struct patch: index out of range"),
        (F.array(diff.op(6, diff.LIST_REMOVE, 1), diff.op(6, diff.LIST_STRUCT_PATCH, 1, nested(0))), "struct patch: index out of range"),
        (F.array(diff.op(6, diff.LIST_STRUCT_PATCH, 0, nested(9))), patch.UNKNOWN),
        (F.array(diff.op(5, diff.STRUCT_PATCH, -1, nested(9))), patch.UNKNOWN),
        (F.array(diff.op(5, diff.STRUCT_PATCH, -1, nested(0)), diff.op(99, diff.SET, -1, F.lit("x"))), ""),
        (F.array(diff.op(2, diff.LIST_INSERT, 1, F.lit("true"))), "insert: index out of range"),
    ]
    for ops, want in cases:
        rows = df.select("old", ops.alias("ops"))
        assert rows.select(patch.error(F.col("old"), F.col("ops"), S["Rec"], S)).first()[0] == want
        made = rows.select(patch.apply(F.col("old"), F.col("ops"), S["Rec"], S).alias("r"))
        if want:
            with pytest.raises(Exception, match=want):
                made.collect()
        else:
            assert made.first().r is not None
    good = df.select("old", cases[0][0].alias("ops"))
    with pytest.raises(Exception, match="version: 2"):
        good.select(patch.apply(F.col("old"), F.col("ops"), S["Rec"], S, version=F.lit(2))).collect()


def test_resolvers(spark):
    from quern.operators import resolving

    hosts = spark.createDataFrame([("a", "1.2.3.4"), ("a", "::1")], "host string, ip string")
    known = resolving.Registry()
    assert known.get("dns") is None
    known.register("dns", resolving.dns(hosts))
    assert known.schemes() == ["dns", "passthrough"]
    asked = [(1, "a:7"), (2, "dns:///a"), (3, "dns:///b"), (4, "x://y/z"), (5, ""), (6, "dns:///[::2]:9"), (7, "dns:///256.1.1.1")]
    got = known.resolve(spark.createDataFrame(asked, "id int, t string"), "t", "53").collect()
    assert sorted((r.id, r.addr or r.error) for r in got) == [(1, "a:7"), (2, "1.2.3.4:53"), (2, "[::1]:53"), (3, "no addresses"), (4, "unknown scheme x"), (5, "empty target"), (6, "[::2]:9"), (7, "no addresses")]


def test_numbers_in_ranges(spark):
    from quern.operators import routing

    rng = random.Random(9)
    rows = [(rng.choice("ab"), k) for k in rng.sample(range(-500, 100_000), 400)] + [("c", 7)]
    df = spark.createDataFrame(rows, "g string, o long")
    got = {(r.g, r.o): r.k for r in routing.numbered_in_ranges(df, "o", ["g"]).collect()}
    assert got == {(r.g, r.o): r.k for r in routing.numbered(df, ["o"], ["g"]).collect()}
    assert routing.numbered_in_ranges(df.where("false"), "o", ["g"]).count() == 0 and routing.numbered_in_ranges(df.where("o = 7"), "o", ["g"]).first().k == 0


def test_large_sessions_are_not_gathered(spark):
    df = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (2, 0, "x"), (None, 0, "y"), (3, 0, None)], "c long, s long, p string")
    got = {r.c: (r.n, r.body) for r in frames.reassemble(df, "c", "s", "p", joiner="-", most=3).collect()}
    assert got == {1: (2, None), 2: (1, "x"), None: (1, "y"), 3: (1, "")}
    assert {r.c: r.body for r in frames.reassemble(df, "c", "s", "p", joiner="-").collect()}[1] == "ab-cd"
