"""Lists, maps, enums, polymorphic values, text forms, packing and compression over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import presence
from quern.functions.schema import Struct, parse, type_hash
from quern.operators import anys, arrays, bits, enums, maps
from quern.shipping import new_folder
from quern.sources import binary, compress, framed, json_text, pack, text

from .records import ORACLE, QUERIES, query
from .tables import LISTS, PRIORITY, SHOP, baskets, customers, orders, table

S = SHOP.structs
__all__ = ["ORACLE", "QUERIES"]

def _quantities(spark, sf_dir):
    return baskets(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), F.transform("Lines", lambda x: x["Quantity"]).alias("q"))


@query("SELECT vec_id, CAST(len(embedding[3:5]) AS INTEGER) AS n_inside, CAST(len(embedding[63:64]) AS INTEGER) AS n_clamped, CAST(0 AS INTEGER) AS n_outside, round(embedding[3]::DOUBLE, 4) AS first FROM embeddings")
def list_range_clamped(spark, sf_dir):
    e = F.col("embedding")
    inside = arrays.between(e, 2, 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(inside).alias("n_inside"), F.size(arrays.between(e, 62, 100)).alias("n_clamped"), F.size(arrays.between(e, 80, 90)).alias("n_outside"), F.round(arrays.get(inside, 0).cast("double"), 4).alias("first"))


@query(f"WITH b AS ({LISTS}) SELECT k AS o_orderkey, q[1] AS first, q[len(q)] AS last, list_sum(q) - q[1] + 5.0 AS total_after_set FROM b")
def list_get_set(spark, sf_dir):
    q = F.col("q")
    return _quantities(spark, sf_dir).select("o_orderkey", arrays.get(q, 0).alias("first"), arrays.get(q, F.size(q) - 1).alias("last"), F.aggregate(arrays.put(q, 0, 5.0), F.lit(0.0), lambda a, x: a + x).alias("total_after_set"))


@query(f"WITH b AS ({LISTS}) SELECT k AS o_orderkey, CAST(len(q) AS INTEGER) AS n, CAST(len(q) + 2 AS INTEGER) AS n_after, list_sum(q) + 3.0 AS total FROM b")
def list_append_len(spark, sf_dir):
    longer = arrays.append(F.col("q"), 1.0, 2.0)
    return _quantities(spark, sf_dir).select("o_orderkey", arrays.length(F.col("q")).alias("n"), F.size(longer).alias("n_after"), F.aggregate(longer, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS pos, l_quantity AS quantity FROM lineitem")
def list_all(spark, sf_dir):
    return _quantities(spark, sf_dir).select("o_orderkey", F.posexplode("q").alias("pos", "quantity"))


def _line_map(spark, sf_dir):
    """Quantity by line number of each order (lines that share a number are summed)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "q"))).alias("m"))


LINES = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {LINES} SELECT k AS o_orderkey, string_agg(n::VARCHAR, ',' ORDER BY n) AS keys, string_agg(q::BIGINT::VARCHAR, ',' ORDER BY n) AS vals FROM l GROUP BY 1")
def map_sorted_entries(spark, sf_dir):
    m = F.col("m")
    return _line_map(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(maps.keys(m), lambda x: x.cast("string")), ",").alias("keys"), F.array_join(F.transform(maps.values(m), lambda x: x.cast("long").cast("string")), ",").alias("vals"))


@query(f"WITH {LINES} SELECT k AS o_orderkey, max(CASE WHEN n = 2 THEN q END) AS second, bool_or(n = 2) AS has_second, bool_or(n = 5) AS has_fifth FROM l GROUP BY 1")
def map_get_has(spark, sf_dir):
    m = F.col("m")
    return _line_map(spark, sf_dir).select("o_orderkey", maps.get(m, 2).alias("second"), maps.has(m, 2).alias("has_second"), maps.has(m, 5).alias("has_fifth"))


@query(f"WITH {LINES} SELECT k AS o_orderkey, CAST(count(*) FILTER (n NOT IN (2, 9)) + 1 AS INTEGER) AS n, coalesce(sum(q) FILTER (n NOT IN (2, 9)), 0) + 50.0 AS total FROM l GROUP BY 1")
def map_set_delete(spark, sf_dir):
    m = maps.put(maps.delete(F.col("m"), 2), 9, 50.0)
    return _line_map(spark, sf_dir).select("o_orderkey", maps.length(m).alias("n"), F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {LINES} SELECT k AS o_orderkey, CAST(count(*) AS INTEGER) AS n, CAST(0 AS INTEGER) AS n_cleared FROM l GROUP BY 1")
def map_clear_len(spark, sf_dir):
    return _line_map(spark, sf_dir).select("o_orderkey", maps.length(F.col("m")).alias("n"), maps.length(maps.clear(F.col("m"))).alias("n_cleared"))


@query("SELECT event_id, event_type || '-2' AS type_value, user_id::VARCHAR AS user_value, CAST(2 AS INTEGER) AS n FROM events")
def metadata_case_insensitive(spark, sf_dir):
    def pair(k, v):
        return F.struct(F.lit(k).alias("key"), v.alias("value"))

    kind = F.col("event_type")
    md = maps.metadata(F.array(pair("X-Type", kind), pair("User", F.col("user_id").cast("string")), pair("x-type", F.concat(kind, F.lit("-2")))))
    return table(spark, sf_dir, "events").select("event_id", md.alias("m")).select("event_id", maps.get(F.col("m"), "x-type").alias("type_value"), maps.get(F.col("m"), "user").alias("user_value"), maps.length(F.col("m")).alias("n"))


KINDS = {name: type_hash("shop", name) for name in ("Order", "Customer", "Part")}
_UNKNOWN = type_hash("elsewhere", "Supplier")


def _anys(spark, sf_dir):
    parts = [("orders", "o_orderkey", KINDS["Order"]), ("customer", "c_custkey", KINDS["Customer"]), ("part", "p_partkey", KINDS["Part"]), ("supplier", "s_suppkey", _UNKNOWN)]
    out = None
    for name, key, digest in parts:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), anys.pack(digest, F.col(key).cast("string").cast("binary")).alias("value"))
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT 'orders' AS origin, 'Order' AS type, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders UNION ALL SELECT 'customer', 'Customer', count(*), sum(c_custkey)::BIGINT FROM customer UNION ALL SELECT 'part', 'Part', count(*), sum(p_partkey)::BIGINT FROM part UNION ALL SELECT 'supplier', '', count(*), NULL FROM supplier")
def any_dispatch(spark, sf_dir):
    v = F.col("value")
    known = F.coalesce(*[anys.unpack(v, d, strict=False) for d in KINDS.values()]).cast("string").cast("long")
    return _anys(spark, sf_dir).select("origin", anys.type_of(v, {d: n for n, d in KINDS.items()}).alias("type"), known.alias("k")).groupBy("origin", "type").agg(F.count("*").alias("n"), F.sum("k").alias("ids"))


@query(f"SELECT s_suppkey AS id, '{_UNKNOWN.hex()}' AS hash, s_suppkey::VARCHAR AS data, '{{\"@type\":\"{_UNKNOWN.hex()}\",\"@value\":\"' || base64(encode(s_suppkey::VARCHAR)) || '\"}}' AS json FROM supplier")
def any_unknown_passthrough(spark, sf_dir):
    v = F.col("value")
    rows = _anys(spark, sf_dir).where(anys.type_of(v, {d: n for n, d in KINDS.items()}) == "")
    return rows.select("id", F.lower(F.hex(v["hash"])).alias("hash"), v["data"].cast("string").alias("data"), anys.to_json(v, {}).alias("json"))


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 ELSE 0 END AS INTEGER) AS number, o_orderpriority AS name FROM orders")
def enum_name_to_number(spark, sf_dir):
    number = enums.number_of(F.col("Priority"), PRIORITY)
    return orders(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), number.alias("number"), enums.name_of(number, PRIORITY).alias("name"))


@query("SELECT o_orderpriority AS name, CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS by_number, CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS by_name, count(*) AS n FROM orders GROUP BY 1")
def enum_order(spark, sf_dir):
    counts = orders(spark, sf_dir).groupBy("Priority").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(enums.listing(spark, PRIORITY)), F.col("Priority") == F.col("name")).select("name", "by_number", "by_name", "n")


@query("SELECT o_orderkey, (o_custkey & 8) <> 0 AS bit3, CAST((o_custkey >> 2) & 15 AS BIGINT) AS middle, CAST(o_custkey | 64 AS BIGINT) AS with6, CAST(o_custkey & ~2 AS BIGINT) AS without1, CAST((o_custkey & ~240) | 160 AS BIGINT) AS stored FROM orders")
def bit_operators(spark, sf_dir):
    x = F.col("Custkey")
    return orders(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), bits.get_bit(x, 3).alias("bit3"), bits.get_value(x, 2, 6).alias("middle"), bits.set_bit(x, 6).alias("with6"), bits.clear_bit(x, 1).alias("without1"), bits.set_value(x, F.lit(10), 4, 8).alias("stored"))


@query("""SELECT n_nationkey, '{"Nationkey":' || n_nationkey || ',"Name":"' || n_name || '","Regionkey":' || n_regionkey || '}' AS json FROM nation""")
def json_marshal_flat(spark, sf_dir):
    r = F.struct(F.col("n_nationkey").alias("Nationkey"), F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", json_text.to_json(r, S["Nation"], S).alias("json"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_roundtrip(spark, sf_dir):
    r = F.struct(F.col("conv_id").alias("Conv"), F.col("turn").alias("Turn"), F.col("role").alias("Role"), F.col("text").alias("Text"))
    rows = table(spark, sf_dir, "conversations").select(json_text.to_json(r, S["Turn"], S).alias("j"))
    back = rows.select(json_text.from_json(F.col("j"), S["Turn"], S).alias("r"))
    return back.select(F.col("r.Conv").alias("conv_id"), F.col("r.Turn").alias("turn"), F.col("r.Role").alias("role"), F.col("r.Text").alias("text"))


@query("""SELECT n_regionkey, '[' || string_agg('{"Nationkey":' || n_nationkey || ',"Name":"' || n_name || '","Regionkey":' || n_regionkey || '}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY 1""")
def json_array_writer(spark, sf_dir):
    r = F.struct(F.col("n_nationkey").alias("Nationkey"), F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Regionkey"))
    return json_text.json_arrays(table(spark, sf_dir, "nation"), "n_regionkey", json_text.to_json(r, S["Nation"], S), F.col("n_nationkey"))


@query("""SELECT r_regionkey, 'Regionkey: ' || r_regionkey || ',' || chr(10) || 'Name: "' || r_name || '",' || chr(10) AS text FROM region""")
def text_marshal_flat(spark, sf_dir):
    r = F.struct(F.col("r_regionkey").alias("Regionkey"), F.col("r_name").alias("Name"))
    return table(spark, sf_dir, "region").select("r_regionkey", text.to_text(r, "Region", SHOP).alias("text"))


@query("SELECT c_custkey, c_name, n_nationkey, n_name, n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def text_roundtrip(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.struct(F.col("n_nationkey").alias("Nationkey"), F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Regionkey")).alias("Home"))
    rows = customers(spark, sf_dir).join(F.broadcast(nation), F.col("Nationkey") == F.col("n_nationkey"), "left")
    written = rows.select(text.to_text(F.struct("Custkey", "Name", "Home"), "Resident", SHOP).alias("t"))
    back = text.from_text(written, "t", SHOP, "Resident")
    return back.select(F.col("Custkey").alias("c_custkey"), F.col("Name").alias("c_name"), F.col("Home.Nationkey").alias("n_nationkey"), F.col("Home.Name").alias("n_name"), F.col("Home.Regionkey").alias("n_regionkey"))


@query("SELECT count(*) AS n, count(*) AS same, count(*) AS sizes_agree, true AS smaller FROM orders")
def pack_roundtrip(spark, sf_dir):
    rows = binary.encode_records(orders(spark, sf_dir), SHOP, "Order").withColumn("p", pack.packed(F.col("record")))
    rows = rows.withColumn("u", pack.unpacked(F.col("p")))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("u") == F.col("record")).alias("same"), F.count_if((pack.unpacked_size(F.col("p")) == F.octet_length("record")) & (pack.packed_size(F.col("p")) == F.octet_length("p") - 16)).alias("sizes_agree"), (F.avg(pack.ratio(F.col("p"))) < 1).alias("smaller"))


def _bytes(x: str) -> list[str]:
    return [f"substr(printf('%016x', {x}), {i}, 2)" for i in range(15, 0, -2)]


@query(f"SELECT o_orderkey, CAST({' + '.join(f'CASE WHEN {b} <> $$00$$ THEN {1 << i} ELSE 0 END' for i, b in enumerate(_bytes('o_custkey')))} AS INTEGER) AS tag FROM orders".replace("$$", "'"))
def pack_tag(spark, sf_dir):
    h = F.lpad(F.hex("Custkey"), 16, "0")
    little = F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])
    return orders(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), pack.tag_of(little).alias("tag"))


@query("SELECT unnest(['none', 'gzip', 'snappy', 'zstd']) AS codec, count(*) AS n, count(*) AS same, count(*) FILTER (text IS NULL OR text = '') AS empty FROM documents")
def compress_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("t"))
    out = None
    for name in ("none", "gzip", "snappy", "zstd"):
        rows = docs.withColumn("c", compress.compressed(F.col("t"), name)).withColumn("d", compress.decompressed(F.col("c"), name))
        part = rows.agg(F.lit(name).alias("codec"), F.count("*").alias("n"), F.count_if(F.col("d").eqNullSafe(F.col("t"))).alias("same"), F.count_if(F.coalesce(F.octet_length("c"), F.lit(0)) == 0).alias("empty"))
        out = part if out is None else out.union(part)
    return out


@query("""SELECT struct, CAST(row_number() OVER (PARTITION BY struct ORDER BY place) - 1 AS INTEGER) AS field_num, field_name, CAST(type_id AS INTEGER) AS type_id, false AS is_enum FROM (SELECT struct, unnest(range(0, len(fields))) AS place, unnest(fields) AS field_name, unnest(types) AS type_id FROM (VALUES
  ('Line', ['Linenumber', 'Partkey', 'Suppkey', 'Quantity', 'Price'], [4, 5, 5, 11, 11]), ('Nation', ['Nationkey', 'Name', 'Regionkey'], [4, 12, 4]), ('Region', ['Regionkey', 'Name'], [4, 12]),
  ('Order', ['Orderkey', 'Custkey', 'Status', 'Totalprice', 'Priority'], [5, 5, 12, 11, 12]), ('Basket', ['Orderkey', 'Status', 'Lines'], [5, 12, 54]), ('Amounts', ['Orderkey', 'Quantities'], [5, 51]),
  ('Customer', ['Custkey', 'Name', 'Nationkey', 'Acctbal', 'Mktsegment'], [5, 12, 4, 11, 12]), ('Resident', ['Custkey', 'Name', 'Home'], [5, 12, 14]), ('Turn', ['Conv', 'Turn', 'Role', 'Text'], [5, 5, 12, 12]),
  ('Words', ['Doc', 'Words', 'Lengths', 'Flags'], [5, 53, 44, 41])) AS t(struct, fields, types))""")
def schema_catalog(spark, sf_dir):
    return SHOP.catalog(spark).select("struct", "field_num", "field_name", "type_id", "is_enum")


#: Orders as tickets with an enum and bytes.
DESK = parse("""package desk
enum Level uint16 {
 Open @0
 Urgent @1
 High @2
 Medium @3
 Low @500
}
struct Ticket {
 Id int64 @0
 Level Level @1
 Seal bytes @2
 Past []Level @3
}
""")
_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 500 ELSE 0 END"
_NAME = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Open' END"


def _tickets(spark, sf_dir):
    p, level = F.col("Priority"), F.lit(0)
    for name, number in (("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3), ("5-LOW", 500)):
        level = F.when(p == name, number).otherwise(level)
    past = F.when(F.col("Orderkey") % 2 == 0, F.array(F.lit(500), level)).otherwise(F.array().cast("array<int>"))
    ticket = F.struct(F.col("Orderkey").alias("Id"), level.alias("Level"), F.col("Status").cast("binary").alias("Seal"), past.alias("Past"))
    return orders(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), ticket.alias("r"))


@query(f"""SELECT o_orderkey, '{{"Id":' || o_orderkey || ',"Level":"' || {_NAME} || '","Seal":"' || base64(encode(o_orderstatus)) || '","Past":' || CASE WHEN o_orderkey % 2 = 0 THEN '["Low","' || {_NAME} || '"]' ELSE 'null' END || '}}' AS named,
  '{{"Id":' || o_orderkey || ',"Level":' || {_LEVEL} || ',"Seal":"' || base64(encode(o_orderstatus)) || '","Past":' || CASE WHEN o_orderkey % 2 = 0 THEN '[500,' || {_LEVEL} || ']' ELSE 'null' END || '}}' AS numbered, CAST({_LEVEL} AS INTEGER) AS back FROM orders""")
def json_enum_numbers(spark, sf_dir):
    """Enums by name and by number, and read again from either form, beside a field that is not known."""
    t, known = DESK.structs["Ticket"], (DESK.structs, DESK.enums)
    rows = _tickets(spark, sf_dir).select("o_orderkey", json_text.to_json(F.col("r"), t, *known).alias("named"), json_text.to_json(F.col("r"), t, *known, True).alias("numbered"))
    more = F.concat(F.lit('{"Colour":1,'), F.substring(F.when(F.col("o_orderkey") % 3 == 0, F.col("named")).otherwise(F.col("numbered")), 2, 1 << 20))
    flat = Struct("Flat", t.fields[:2])
    return rows.select("*", json_text.from_json(more, flat, *known, ignore_unknown=True)["Level"].cast("int").alias("back"))


@query(f"""SELECT o_orderkey, 'Id: ' || o_orderkey || ',' || chr(10) || 'Level: ' || {_LEVEL} || ',' || chr(10) || 'Seal: 0x' || lower(hex(encode(o_orderstatus))) || ',' || chr(10) || 'Past: ' || CASE WHEN o_orderkey % 2 = 0 THEN '[500, ' || {_LEVEL} || ']' ELSE 'null' END || ',' || chr(10) AS text FROM orders""")
def text_numbers_and_hex(spark, sf_dir):
    return _tickets(spark, sf_dir).select("o_orderkey", text.to_text(F.col("r"), "Ticket", DESK, True, True).alias("text"))


#: Fields whose sizes depend on each value.
MIXED = parse("package mixed\noptions [ IsSet() ]\nstruct Mixed {\n Lines map[int32]float64 @0\n Notes map[string]string @1\n One Any @2\n Many []Any @3\n}\n")


@query(f"""WITH {LINES}, s AS (SELECT k, count(*) AS n, CAST(sum(CASE WHEN n <= 9 THEN 1 ELSE 2 END) AS BIGINT) AS digits FROM l GROUP BY 1), z AS (SELECT k, 8 + 8 + (12 * n + 7) // 8 * 8 + 8 + (9 * n + digits + 7) // 8 * 8 + CASE WHEN k % 3 = 0 THEN 0 ELSE 24 + strlen(k::VARCHAR) END + CASE WHEN k % 2 = 0 THEN 0 ELSE 8 + 32 + 1 END AS b FROM s)
  SELECT k AS o_orderkey, CAST(b AS BIGINT) AS bytes, CAST(b + 8 AS BIGINT) AS bytes_with_bits, CAST(b AS BIGINT) AS actual FROM z""")
def encoded_size_composites(spark, sf_dir):
    """Maps, Any and lists of Any; the stated size is that of the encoded record."""
    k = F.col("o_orderkey")
    one = F.when(k % 3 != 0, anys.pack(KINDS["Order"], k.cast("string").cast("binary")))
    many = F.when(k % 2 != 0, F.array(anys.pack(KINDS["Order"], F.lit(b"")), anys.pack(KINDS["Part"], F.lit(b"x"))))
    notes = F.map_from_entries(F.transform(F.map_keys("m"), lambda x: F.struct(x.cast("string").alias("key"), F.lit("z").alias("value"))))
    rows = _line_map(spark, sf_dir).select("o_orderkey", F.transform_keys("m", lambda x, _: x.cast("int")).alias("Lines"), notes.alias("Notes"), one.alias("One"), many.alias("Many"))
    r, s = F.struct("Lines", "Notes", "One", "Many"), MIXED.structs
    sized = rows.select("*", presence.record_size(r, s["Mixed"], s).alias("bytes"), presence.record_size(r, s["Mixed"], s, True).alias("bytes_with_bits"))
    made = binary.encode_records(sized, MIXED, "Mixed", keep=("o_orderkey", "bytes", "bytes_with_bits"))
    return made.select("o_orderkey", "bytes", "bytes_with_bits", F.octet_length("record").cast("long").alias("actual"))


@query("""SELECT s_suppkey, CAST(2 + (s_suppkey % 2) AS INTEGER) AS n, 'Order' AS first, CASE WHEN s_suppkey % 2 = 1 THEN 'Part' ELSE '' END AS third, CAST(s_suppkey AS VARCHAR) AS second, CASE WHEN s_suppkey % 2 = 1 THEN '' ELSE 'not set' END AS third_error, 'type mismatch' AS first_error, 'not set' AS before_error FROM supplier""")
def any_list_items(spark, sf_dir):
    key = F.col("s_suppkey").cast("string").cast("binary")
    pair = anys.list_set(anys.pack(KINDS["Order"], F.lit(b"o")), anys.pack(KINDS["Customer"], key))
    v = F.when(F.col("s_suppkey") % 2 == 1, F.concat(pair, anys.list_set(anys.pack(KINDS["Part"], key)))).otherwise(pair)
    names = {d: n for n, d in KINDS.items()}
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v"))
    v = F.col("v")
    return rows.select(
        "s_suppkey", anys.list_length(v).alias("n"), anys.type_of(anys.list_get_raw(v, 0), names).alias("first"), anys.type_of(anys.list_get_raw(v, 2), names).alias("third"), anys.list_get(v, 1, KINDS["Customer"]).cast("string").alias("second"),
        anys.list_get_error(v, 2, KINDS["Part"]).alias("third_error"), anys.list_get_error(v, 0, KINDS["Part"]).alias("first_error"), anys.list_get_error(v, -1, KINDS["Part"]).alias("before_error"),
    )


@query("SELECT count(*) AS n, count(*) AS distinct_records FROM customer")
def framed_files(spark, sf_dir):
    """Records written and read again as files of concatenated records, through the data source."""
    folder = new_folder(spark, "framed")
    framed.register(spark)
    binary.encode_records(customers(spark, sf_dir), SHOP, "Customer").write.format("quern_records").mode("overwrite").save(folder)
    return spark.read.format("quern_records").load(folder).agg(F.count("*").alias("n"), F.countDistinct("record").alias("distinct_records"))



@query(f"WITH {LINES} SELECT k AS o_orderkey, count(*) FILTER (n = 2) AS deletes, count(*) FILTER (n = 3) AS sets FROM l GROUP BY 1")
def map_diff_ops(spark, sf_dir):
    """Extension: line 2 goes, line 3 changes."""
    from quern.operators import recording

    m = F.col("m")
    new = F.transform_values(maps.delete(m, 2), lambda k, v: F.when(k == 3, v + 1).otherwise(v))
    rows = _line_map(spark, sf_dir).select("o_orderkey", recording.map_diff(m, new).alias("ops"))
    return rows.select("o_orderkey", *[F.size(F.filter("ops", lambda o: o["type"] == kind)).cast("long").alias(name) for kind, name in ((10, "deletes"), (9, "sets"))])
