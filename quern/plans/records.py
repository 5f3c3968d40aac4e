"""Diff, patch, presence, sizes and token streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import presence
from quern.functions.types import Ref
from quern.operators import arrays, diff, patch, tokens
from quern.sources import binary

from .tables import LISTS, SHOP, baskets, customers, edited_orders, orders, sparse_customers, table

S = SHOP.structs
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


AFTER = """after AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)"""


def _changes(spark, sf_dir):
    before = orders(spark, sf_dir)
    return diff.snapshot_diff(before, edited_orders(before), "Orderkey", S["Order"], S)


@query(f"""WITH {AFTER}, ops AS (
  SELECT b.o_orderkey, 'update' AS change, 2 AS field_num, CASE WHEN a.o_orderstatus = '' THEN 2 ELSE 1 END AS op_type, CASE WHEN a.o_orderstatus = '' THEN NULL ELSE a.o_orderstatus END AS text_value, CAST(NULL AS DOUBLE) AS num_value
    FROM orders b JOIN after a USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
  UNION ALL SELECT b.o_orderkey, 'update', 3, 1, NULL, round(a.o_totalprice, 2) FROM orders b JOIN after a USING (o_orderkey) WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice
  UNION ALL SELECT b.o_orderkey, 'update', 4, CASE WHEN a.o_orderpriority = '' THEN 2 ELSE 1 END, CASE WHEN a.o_orderpriority = '' THEN NULL ELSE a.o_orderpriority END, NULL FROM orders b JOIN after a USING (o_orderkey) WHERE a.o_orderpriority IS DISTINCT FROM b.o_orderpriority
  UNION ALL SELECT o_orderkey, 'delete', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 17 = 0)
SELECT o_orderkey, change, CAST(field_num AS INTEGER) AS field_num, CAST(op_type AS INTEGER) AS op_type, text_value, num_value FROM ops""")
def snapshot_diff_scalar(spark, sf_dir):
    changed = _changes(spark, sf_dir).where("change <> 'same'").select(F.col("Orderkey").alias("o_orderkey"), "change", F.explode_outer("ops").alias("o"))
    is_number = F.col("o.field_num") == 3
    return changed.select("o_orderkey", "change", F.col("o.field_num").alias("field_num"), F.col("o.type").alias("op_type"), F.when(~is_number, F.col("o.value")).alias("text_value"), F.when(is_number, F.round(F.col("o.value").cast("double"), 2)).alias("num_value"))


@query(f"""WITH {AFTER} SELECT b.o_orderkey, CAST((a.o_orderstatus <> b.o_orderstatus)::INT + (a.o_totalprice <> b.o_totalprice)::INT + (a.o_orderpriority <> b.o_orderpriority)::INT AS INTEGER) AS n_ops,
  (a.o_orderstatus = b.o_orderstatus AND a.o_totalprice = b.o_totalprice AND a.o_orderpriority = b.o_orderpriority) AS is_empty
  FROM orders b JOIN after a USING (o_orderkey)""")
def snapshot_diff_ops_per_row(spark, sf_dir):
    return _changes(spark, sf_dir).where("change in ('same', 'update')").select(F.col("Orderkey").alias("o_orderkey"), F.size("ops").alias("n_ops"), diff.is_empty(F.col("ops")).alias("is_empty"))


def _edited_lists(spark, sf_dir):
    """Quantities of each order before and after: every third changes, even orders lose their last two, every fifth order gains two."""
    k = F.col("Orderkey")
    old = F.transform("Lines", lambda x: x["Quantity"])
    rows = baskets(spark, sf_dir).select("Orderkey", old.alias("old"))
    new = F.transform("old", lambda x, i: F.when(i % 3 == 2, x + 1).otherwise(x))
    new = F.when(k % 2 == 0, F.slice(new, 1, F.greatest(F.size("old") - 2, F.lit(0)))).otherwise(new)
    return rows.withColumn("new", F.when(k % 5 == 0, F.concat(new, F.array(F.lit(98.0), F.lit(99.0)))).otherwise(new))


EDITED = f"""base AS ({LISTS}), step AS (SELECT k, q AS old, list_transform(q, lambda x, i: CASE WHEN i % 3 = 0 THEN x + 1 ELSE x END) AS s FROM base),
  cut AS (SELECT k, old, CASE WHEN k % 2 = 0 THEN s[1:greatest(len(s) - 2, 0)] ELSE s END AS s FROM step),
  both_lists AS (SELECT k, old, CASE WHEN k % 5 = 0 THEN list_concat(s, [98.0::DOUBLE, 99.0::DOUBLE]) ELSE s END AS new FROM cut),
  counted AS (SELECT k, old, new, len(old) AS n, len(new) AS m, list_filter(range(1, least(len(old), len(new)) + 1), lambda i: old[i] <> new[i]) AS sets FROM both_lists),
  decided AS (SELECT *, len(sets) + abs(n - m) AS ops, len(sets) + abs(n - m) > (n + m) // 2 AS swap FROM counted)"""


def _list_ops(spark, sf_dir):
    rows = _edited_lists(spark, sf_dir)
    a, b = (F.struct("Orderkey", F.col(c).alias("Quantities")) for c in ("old", "new"))
    return rows.select("Orderkey", "old", "new", diff.diff(a, b, S["Amounts"], S).alias("ops"))


@query(f"""WITH {EDITED} SELECT k AS o_orderkey, CAST(CASE WHEN swap THEN 0 ELSE len(sets) END AS INTEGER) AS n_set, CAST(CASE WHEN swap THEN 0 ELSE greatest(m - n, 0) END AS INTEGER) AS n_insert,
  CAST(CASE WHEN swap THEN 0 ELSE greatest(n - m, 0) END AS INTEGER) AS n_remove, CAST(swap::INT AS INTEGER) AS n_replace,
  CASE WHEN swap THEN '-1' ELSE array_to_string(list_concat(list_transform(sets, lambda i: CAST(i - 1 AS VARCHAR)), list_concat(list_transform(range(n, m), lambda i: CAST(i AS VARCHAR)), list_transform(range(0, greatest(n - m, 0)), lambda i: CAST(n - 1 - i AS VARCHAR)))), ',') END AS places
  FROM decided""")
def diff_list_positional(spark, sf_dir):
    def count(kind):
        return F.size(F.filter("ops", lambda o: o["type"] == kind))

    return _list_ops(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), count(5).alias("n_set"), count(6).alias("n_insert"), count(7).alias("n_remove"), count(4).alias("n_replace"), F.array_join(F.transform("ops", lambda o: o["index"].cast("string")), ",").alias("places"))


@query(f"WITH {EDITED} SELECT CAST(n AS INTEGER) AS old_len, CAST(m AS INTEGER) AS new_len, CAST(ops AS INTEGER) AS edits, bool_and(swap) AS replaced, count(*) AS n FROM decided GROUP BY 1, 2, 3")
def diff_list_replace_heuristic(spark, sf_dir):
    rows = _list_ops(spark, sf_dir)
    n, m = F.size("old"), F.size("new")
    both = F.arrays_zip(F.slice("old", 1, F.least(n, m)).alias("a"), F.slice("new", 1, F.least(n, m)).alias("b"))
    edits = F.size(F.filter(both, lambda x: x["a"] != x["b"])) + F.abs(n - m)
    replaced = F.exists("ops", lambda o: o["type"] == diff.LIST_REPLACE)
    return rows.groupBy(n.alias("old_len"), m.alias("new_len"), edits.alias("edits")).agg(F.bool_and(replaced).alias("replaced"), F.count("*").alias("n"))


def _residents(spark, sf_dir):
    home = F.struct(F.col("n_nationkey").alias("Nationkey"), F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Regionkey"))
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    old = F.when(k % 15 != 1, home)
    new = F.when(k % 10 != 0, home.withField("Name", F.when(k % 4 == 0, "").otherwise(F.col("n_name"))).withField("Regionkey", F.when(k % 6 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey"))))
    return rows.select(k.alias("Custkey"), F.struct(k.alias("Custkey"), F.col("c_name").alias("Name"), old.alias("Home")).alias("old"), F.struct(k.alias("Custkey"), F.col("c_name").alias("Name"), new.alias("Home")).alias("new"))


@query("""SELECT c_custkey, CAST(CASE WHEN c_custkey % 15 = 1 AND c_custkey % 10 <> 0 THEN 1 WHEN c_custkey % 15 <> 1 AND c_custkey % 10 = 0 THEN 2
  WHEN c_custkey % 15 = 1 THEN 0 WHEN c_custkey % 4 = 0 OR c_custkey % 6 = 0 THEN 3 ELSE 0 END AS INTEGER) AS op_type,
  CAST(CASE WHEN c_custkey % 15 = 1 OR c_custkey % 10 = 0 THEN 0 ELSE (c_custkey % 4 = 0)::INT + (c_custkey % 6 = 0)::INT END AS INTEGER) AS nested_ops FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def diff_nested_struct(spark, sf_dir):
    ops = diff.diff(F.col("old"), F.col("new"), S["Resident"], S)
    rows = _residents(spark, sf_dir).select("Custkey", ops.alias("ops"))
    first = F.get("ops", 0)
    nested = F.when(first["type"] == 3, F.size(F.from_json(first["value"], f"array<{diff.OP}>"))).otherwise(0)
    return rows.select(F.col("Custkey").alias("c_custkey"), F.coalesce(first["type"], F.lit(0)).alias("op_type"), F.coalesce(nested, F.lit(0)).alias("nested_ops"))


def _edited_baskets(spark, sf_dir):
    k = F.col("Orderkey")
    new = F.transform("Lines", lambda x: F.when((x["Linenumber"] == 2) & (k % 3 == 0), x.withField("Quantity", x["Quantity"] + 1)).otherwise(x))
    new = F.when(k % 4 == 0, F.slice(new, 1, F.greatest(F.size("Lines") - 1, F.lit(0)))).otherwise(new)
    return baskets(spark, sf_dir).select("Orderkey", F.struct(k, F.lit("O").alias("Status"), F.col("Lines")).alias("old"), F.struct(k, F.lit("O").alias("Status"), new.alias("Lines")).alias("new"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS ln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
  c AS (SELECT k, max(n) AS n, max(CASE WHEN k % 4 = 0 THEN n - 1 ELSE n END) AS m, count(*) FILTER (ln = 2 AND k % 3 = 0 AND pos <= CASE WHEN k % 4 = 0 THEN n - 1 ELSE n END) AS patched FROM l GROUP BY 1)
  SELECT k AS o_orderkey, CAST(CASE WHEN patched + n - m > (n + m) // 2 THEN 0 ELSE patched END AS INTEGER) AS n_patch, CAST(CASE WHEN patched + n - m > (n + m) // 2 THEN 0 ELSE n - m END AS INTEGER) AS n_remove, CAST((patched + n - m > (n + m) // 2)::INT AS INTEGER) AS n_replace FROM c""")
def diff_struct_list(spark, sf_dir):
    def count(kind):
        return F.size(F.filter("ops", lambda o: o["type"] == kind))

    rows = _edited_baskets(spark, sf_dir).select("Orderkey", diff.diff(F.col("old"), F.col("new"), S["Basket"], S).alias("ops"))
    return rows.select(F.col("Orderkey").alias("o_orderkey"), count(8).alias("n_patch"), count(7).alias("n_remove"), count(4).alias("n_replace"))


@query("""SELECT 'flat' AS kind, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT 'list', count(DISTINCT l_orderkey), 0 FROM lineitem UNION ALL SELECT 'nested', count(*), 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'struct list', count(DISTINCT l_orderkey), 0 FROM lineitem""")
def apply_patch_roundtrip(spark, sf_dir):
    before = orders(spark, sf_dir)
    flat = before.select("Orderkey", F.struct("*").alias("old")).join(edited_orders(before).select("Orderkey", F.struct("*").alias("new")), "Orderkey")
    lists = _edited_lists(spark, sf_dir).select(F.struct("Orderkey", F.col("old").alias("Quantities")).alias("old"), F.struct("Orderkey", F.col("new").alias("Quantities")).alias("new"))
    out = None
    for kind, rows, name in (("flat", flat, "Order"), ("list", lists, "Amounts"), ("nested", _residents(spark, sf_dir), "Resident"), ("struct list", _edited_baskets(spark, sf_dir), "Basket")):
        ops = diff.diff(F.col("old"), F.col("new"), S[name], S)
        made = rows.select("old", "new", ops.alias("ops")).select("new", patch.apply(F.col("old"), F.col("ops"), S[name], S).alias("made"))
        part = made.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_rows"), F.count_if(~F.col("made").eqNullSafe(F.col("new"))).alias("n_wrong"))
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH b AS ({LISTS}) SELECT k AS o_orderkey, CASE WHEN len(q) > 2 THEN '' ELSE 'set: index out of range' END AS set_error, CASE WHEN len(q) >= 2 THEN '' ELSE 'insert: index out of range' END AS insert_error,
  CASE WHEN len(q) > 1 THEN '' ELSE 'remove: index out of range' END AS remove_error, CASE WHEN len(q) >= 2 THEN CAST(len(q) + 1 AS INTEGER) END AS n_inserted, CASE WHEN len(q) >= 2 THEN list_sum(q) + 7.0 END AS inserted_sum,
  CASE WHEN len(q) > 1 THEN list_sum(q) - q[2] END AS removed_sum FROM b""")
def apply_list_ops(spark, sf_dir):
    q = F.col("q")
    rows = baskets(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), F.transform("Lines", lambda x: x["Quantity"]).alias("q"))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    more, less = arrays.insert(q, 2, 7.0), arrays.remove(q, 1)
    return rows.select("o_orderkey", *[arrays.edit_error(op, q, i).alias(f"{op}_error") for op, i in (("set", 2), ("insert", 2), ("remove", 1))], F.when(more.isNotNull(), F.size(more)).alias("n_inserted"), total(more).alias("inserted_sum"), total(less).alias("removed_sum"))


SPARSE = "s AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer)"


@query(f"WITH {SPARSE} SELECT c_custkey, (c_custkey <> 0)::INT || '' || (c_name <> '')::INT || (c_nationkey <> 0)::INT || (c_acctbal <> 0)::INT || (c_mktsegment <> '')::INT AS mask FROM s")
def presence_mask(spark, sf_dir):
    return sparse_customers(spark, sf_dir).select(F.col("Custkey").alias("c_custkey"), presence.mask(F.struct("*"), S["Customer"]).alias("mask"))


@query(f"""WITH {SPARSE} SELECT unnest(['Acctbal', 'Custkey', 'Mktsegment', 'Name', 'Nationkey']) AS field, unnest([count(*) FILTER (c_acctbal <> 0), count(*) FILTER (c_custkey <> 0), count(*) FILTER (c_mktsegment <> ''), count(*) FILTER (c_name <> ''), count(*) FILTER (c_nationkey <> 0)]) AS stored FROM s""")
def sparse_field_counts(spark, sf_dir):
    rows = sparse_customers(spark, sf_dir)
    counts = rows.agg(*[F.count_if(presence.is_set(F.col(f.name), f.ref)).alias(f.name) for f in S["Customer"].fields])
    return counts.unpivot([], [f.name for f in S["Customer"].fields], "field", "stored")


@query(f"WITH {SPARSE} SELECT c_custkey, (c_acctbal IS NULL OR c_acctbal = 0) AS bare, c_name AS name, CAST(0 AS DOUBLE) AS cleared, 'x' || c_mktsegment AS marked FROM s")
def field_get_set_clear(spark, sf_dir):
    record = F.struct("*")
    rows = sparse_customers(spark, sf_dir).select(record.alias("r"))
    wiped = presence.clear(F.col("r"), S["Customer"], "Acctbal")
    return rows.select(F.col("r.Custkey").alias("c_custkey"), (~presence.is_set(F.col("r.Acctbal"), Ref("float64"))).alias("bare"), presence.value(F.col("r.Name"), Ref("string")).alias("name"), wiped["Acctbal"].alias("cleared"), F.col("r").withField("Mktsegment", F.concat(F.lit("x"), F.col("r.Mktsegment")))["Mktsegment"].alias("marked"))


FLAT_SIZE = "8 + CASE WHEN o_orderkey <> 0 THEN 16 ELSE 0 END + CASE WHEN o_custkey <> 0 THEN 16 ELSE 0 END + CASE WHEN o_orderstatus <> '' THEN 8 + (strlen(o_orderstatus) + 7) // 8 * 8 ELSE 0 END + CASE WHEN o_totalprice <> 0 THEN 16 ELSE 0 END + CASE WHEN o_orderpriority <> '' THEN 8 + (strlen(o_orderpriority) + 7) // 8 * 8 ELSE 0 END"


@query(f"SELECT o_orderkey, CAST({FLAT_SIZE} AS BIGINT) AS bytes, CAST({FLAT_SIZE} + 8 AS BIGINT) AS bytes_with_bits FROM orders")
def encoded_size_flat(spark, sf_dir):
    r = F.struct("*")
    return orders(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), presence.record_size(r, S["Order"], S).alias("bytes"), presence.record_size(r, S["Order"], S, True).alias("bytes_with_bits"))


@query("""SELECT l_orderkey AS o_orderkey, CAST(8 + CASE WHEN l_orderkey <> 0 THEN 16 ELSE 0 END + 16 + 8 + sum(8 + CASE WHEN l_linenumber <> 0 THEN 8 ELSE 0 END + CASE WHEN l_partkey <> 0 THEN 16 ELSE 0 END + CASE WHEN l_suppkey <> 0 THEN 16 ELSE 0 END + CASE WHEN l_quantity <> 0 THEN 16 ELSE 0 END + CASE WHEN l_extendedprice <> 0 THEN 16 ELSE 0 END) AS BIGINT) AS bytes FROM lineitem GROUP BY l_orderkey""")
def encoded_size_nested(spark, sf_dir):
    r = F.struct("Orderkey", F.lit("O").alias("Status"), "Lines")
    return baskets(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), presence.record_size(r, S["Basket"], S).alias("bytes"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, CAST(8 + (list_sum(list_transform(w, lambda x: strlen(x) + 4)) + 7) // 8 * 8 AS BIGINT) AS strings, CAST(8 + 4 * len(w) AS BIGINT) AS numbers, CAST(8 + ((len(w) + 7) // 8 + 7) // 8 * 8 AS BIGINT) AS bools FROM w""")
def encoded_size_lists(spark, sf_dir):
    w = F.split("text", " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("Words"), F.transform(w, lambda x: F.length(x)).alias("Lengths"), F.transform(w, lambda x: F.length(x) > 3).alias("Flags"))
    sizes = {f.name: presence.field_size(F.col(f.name), f.ref, S) for f in S["Words"].fields[1:]}
    return rows.select("doc_id", sizes["Words"].alias("strings"), sizes["Lengths"].alias("numbers"), sizes["Flags"].alias("bools"))


@query(f"""WITH {AFTER}, p AS (SELECT b.o_orderkey, a.o_orderstatus <> b.o_orderstatus AS s, a.o_totalprice <> b.o_totalprice AS t, a.o_orderpriority <> b.o_orderpriority AS r FROM orders b JOIN after a USING (o_orderkey)),
  sized AS (SELECT o_orderkey, CASE WHEN s OR t OR r THEN 24 ELSE 16 END + CASE WHEN s THEN 48 ELSE 0 END + CASE WHEN t THEN 48 ELSE 0 END + CASE WHEN r THEN 32 ELSE 0 END AS n FROM p),
  total AS (SELECT sum({FLAT_SIZE}) AS n FROM after)
  SELECT CAST(sum(sized.n) AS BIGINT) AS patch_bytes, CAST(any_value(total.n) AS BIGINT) AS full_bytes, round(sum(sized.n) / any_value(total.n), 6) AS ratio FROM sized, total""")
def patch_size_ratio(spark, sf_dir):
    before = orders(spark, sf_dir)
    after = edited_orders(before)
    patches = _changes(spark, sf_dir).where("change in ('same', 'update')").agg(F.sum(patch.op_size(F.col("ops"), {0: 8, 1: 8, 3: 8})).alias("patch_bytes"))
    full = after.agg(F.sum(presence.record_size(F.struct("*"), S["Order"], S)).alias("full_bytes"))
    # one row beside one row
    both = patches.withColumn("one", F.lit(1)).join(full.withColumn("one", F.lit(1)), "one")
    return both.select("patch_bytes", "full_bytes", F.round(F.col("patch_bytes") / F.col("full_bytes"), 6).alias("ratio"))


def _le(x: str) -> str:
    h = f"printf('%016x', CAST({x} AS BIGINT))"
    return "upper(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + ")"


@query(f"SELECT o_orderkey, {_le('2 + (12 << 16) + (strlen(o_orderstatus)::BIGINT << 24)')} AS status_header, {_le('1 + (4 << 16) + (o_custkey::BIGINT << 24)')} AS custkey_header FROM orders")
def header_encode(spark, sf_dir):
    return orders(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), presence.header(F.lit(2), F.lit(12), F.octet_length("Status")).alias("status_header"), presence.header(F.lit(1), F.lit(4), F.col("Custkey")).alias("custkey_header"))


TOKENS = """t AS (SELECT c_custkey, unnest([{'pos': 0, 'kind': 0, 'path': '', 'type': 0, 'text': NULL::VARCHAR, 'num': NULL::DOUBLE}, {'pos': 1, 'kind': 2, 'path': '.Custkey', 'type': 5, 'text': c_custkey::VARCHAR, 'num': NULL}, {'pos': 2, 'kind': 2, 'path': '.Name', 'type': 12, 'text': c_name, 'num': NULL},
  {'pos': 3, 'kind': 2, 'path': '.Nationkey', 'type': 4, 'text': c_nationkey::VARCHAR, 'num': NULL}, {'pos': 4, 'kind': 2, 'path': '.Acctbal', 'type': 11, 'text': NULL, 'num': round(c_acctbal, 2)}, {'pos': 5, 'kind': 2, 'path': '.Mktsegment', 'type': 12, 'text': c_mktsegment, 'num': NULL}, {'pos': 6, 'kind': 1, 'path': '', 'type': 0, 'text': NULL, 'num': NULL}]) AS x FROM customer)"""


def _customer_tokens(spark, sf_dir):
    return tokens.tokens(customers(spark, sf_dir), "Custkey", F.struct("*"), S["Customer"], S)


@query(f"WITH {TOKENS} SELECT c_custkey, CAST(x.pos AS INTEGER) AS pos, CAST(x.kind AS INTEGER) AS kind, x.path AS path, CAST(x.type AS INTEGER) AS type, x.text AS text, x.num AS num FROM t")
def walk_tokens_flat(spark, sf_dir):
    number = F.col("type") == 11
    return _customer_tokens(spark, sf_dir).select(F.col("Custkey").alias("c_custkey"), "pos", "kind", "path", "type", F.when(~number, F.col("value")).alias("text"), F.when(number, F.round(F.col("value").cast("double"), 2)).alias("num"))


@query(f"WITH {TOKENS} SELECT c_custkey, CAST(x.pos AS INTEGER) AS pos, x.path AS path, lead(x.path) OVER (PARTITION BY c_custkey ORDER BY x.pos) AS next_path FROM t WHERE x.path <> '.Name' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY x.pos) <= 4")
def token_peek_and_skip(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("Custkey").orderBy("pos")
    kept = tokens.skip(_customer_tokens(spark, sf_dir), ".Name")
    return kept.withColumn("next_path", F.lead("path").over(w)).withColumn("n", F.row_number().over(w)).where("n <= 4").select(F.col("Custkey").alias("c_custkey"), "pos", "path", "next_path")


@query("""SELECT l_orderkey AS o_orderkey, CAST(1 + count(*) AS BIGINT) AS struct_starts, CAST(3 + 5 * count(*) AS BIGINT) AS fields, CAST(1 AS BIGINT) AS list_starts FROM lineitem GROUP BY 1""")
def walk_tokens_nested(spark, sf_dir):
    r = F.struct("Orderkey", F.lit("O").alias("Status"), "Lines")
    t = tokens.tokens(baskets(spark, sf_dir), "Orderkey", r, S["Basket"], S)
    return t.groupBy(F.col("Orderkey").alias("o_orderkey")).agg(F.count_if(F.col("kind") == 0).alias("struct_starts"), F.count_if(F.col("kind") == 2).alias("fields"), F.count_if(F.col("kind") == 3).alias("list_starts"))


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def ingest_roundtrip(spark, sf_dir):
    back = tokens.ingest(_customer_tokens(spark, sf_dir).where("kind = 2"), "Custkey", S["Customer"]).select("record.*")
    return back.select(F.col("Custkey").alias("c_custkey"), F.col("Name").alias("c_name"), F.col("Nationkey").alias("c_nationkey"), F.round("Acctbal", 2).alias("c_acctbal"), F.col("Mktsegment").alias("c_mktsegment"))


@query("""SELECT event_id, (event_id % 3 <> 0) AS accepted, CASE WHEN event_id % 3 = 0 THEN '.z' ELSE '' END AS unknown, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def ingest_unknown_fields(spark, sf_dir):
    from quern.functions.schema import Field, Struct

    struct = Struct("Props", [Field("k", 0, Ref("int64"))])
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    pairs = F.array(F.struct(F.lit(".k").alias("path"), F.col("k").alias("value")), F.when(F.col("event_id") % 3 == 0, F.struct(F.lit(".z").alias("path"), F.lit("1").alias("value"))))
    rows = events.select("event_id", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select("event_id", "p.*")
    strict = tokens.ingest(rows, "event_id", struct)
    lenient = tokens.ingest(rows, "event_id", struct, ignore_unknown=True).select("event_id", F.col("record.k").alias("k"))
    return strict.select("event_id", F.col("record").isNotNull().alias("accepted"), F.array_join("unknown", ",").alias("unknown")).join(lenient, "event_id")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders")
def binary_encode_decode(spark, sf_dir):
    encoded = binary.encode_records(orders(spark, sf_dir), SHOP, "Order")
    back = binary.decode_records(encoded, "record", SHOP, "Order")
    return back.select(F.col("Orderkey").alias("o_orderkey"), F.col("Custkey").alias("o_custkey"), F.col("Status").alias("o_orderstatus"), F.round("Totalprice", 2).alias("o_totalprice"), F.col("Priority").alias("o_orderpriority"))


@query("SELECT l_orderkey AS o_orderkey, CAST(count(*) AS INTEGER) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def binary_decode_pruned(spark, sf_dir):
    rows = baskets(spark, sf_dir).select("Orderkey", F.lit("O").alias("Status"), "Lines")
    encoded = binary.encode_records(rows, SHOP, "Basket")
    back = binary.decode_records(encoded, "record", SHOP, "Basket", fields=["Orderkey", "Lines"])
    return back.select(F.col("Orderkey").alias("o_orderkey"), F.size("Lines").alias("n"), F.round(F.aggregate("Lines", F.lit(0.0), lambda a, x: a + x["Quantity"]), 2).alias("quantity"))


@query(f"SELECT o_orderkey, CAST({FLAT_SIZE} AS BIGINT) AS stated, CAST({FLAT_SIZE} AS BIGINT) AS actual FROM orders")
def binary_size_agrees(spark, sf_dir):
    encoded = binary.encode_records(orders(spark, sf_dir), SHOP, "Order", keep=("Orderkey",))
    return encoded.select(F.col("Orderkey").alias("o_orderkey"), binary.record_length("record").alias("stated"), F.octet_length("record").cast("long").alias("actual"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 2 - 1 AS seq FROM events), d AS (SELECT user_id, 2 * (user_id % 7) AS seen FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0))
  SELECT o.user_id, count(*) FILTER (seq > coalesce(seen, 0)) + count(*) FILTER (seq + 1 > coalesce(seen, 0)) AS n, CAST(min(CASE WHEN seq > coalesce(seen, 0) THEN seq WHEN seq + 1 > coalesce(seen, 0) THEN seq + 1 END) AS BIGINT) AS first FROM o LEFT JOIN d ON o.user_id = d.user_id GROUP BY 1""")
def op_log_drain(spark, sf_dir):
    """Two ops an event, of which even users have drained some."""
    from quern.operators import recording

    e = table(spark, sf_dir, "events")
    ops = F.array(diff.op(1, diff.SET, -1, F.col("event_type")), diff.op(2, diff.SET, -1, F.col("props")))
    log = recording.op_log(e.select("user_id", "event_id", ops.alias("ops")), "user_id", "event_id")
    drained = e.where("user_id % 2 = 0").select("user_id", (2 * (F.col("user_id") % 7)).cast("long").alias("seq"))
    return recording.pending(log, "user_id", drained).groupBy("user_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query("""WITH b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT k AS o_orderkey,
  CASE k % 6 WHEN 0 THEN 'struct patch: index out of range' WHEN 1 THEN 'patch of a nested struct names an unknown field' WHEN 2 THEN 'remove: index out of range' WHEN 3 THEN 'unsupported patch version: 2' ELSE '' END AS error,
  CAST(CASE k % 6 WHEN 4 THEN n WHEN 5 THEN n + 1 END AS INTEGER) AS n_lines, CASE WHEN k % 6 = 5 THEN CAST(7 AS DOUBLE) END AS last FROM b""")
def patch_errors(spark, sf_dir):
    """Patches of which some reach past their list, name unknown nested fields or are of another version; two kinds are fine."""
    k, n = F.col("Orderkey"), F.size("Lines")
    rows = baskets(spark, sf_dir).select(k, F.struct(k, F.lit("O").alias("Status"), F.col("Lines")).alias("r"), "Lines")

    def nested(num, value):
        return F.to_json(F.array(diff.op(num, diff.SET, -1, F.lit(value))))

    ops = (
        F.when(k % 6 == 0, F.array(diff.op(2, diff.LIST_STRUCT_PATCH, n, nested(3, "7"))))
        .when(k % 6 == 1, F.array(diff.op(2, diff.LIST_STRUCT_PATCH, 0, nested(99, "7"))))
        .when(k % 6 == 2, F.transform(F.sequence(F.lit(0), n), lambda _: diff.op(2, diff.LIST_REMOVE, 0)))
        .when(k % 6 == 4, F.array(diff.op(77, diff.SET, -1, F.lit("x"))))
        .otherwise(F.array(diff.op(2, diff.LIST_INSERT, n, F.to_json(F.get("Lines", 0))), diff.op(2, diff.LIST_STRUCT_PATCH, n, nested(3, "7"))))
    )
    version = F.when(k % 6 == 3, 2).otherwise(diff.VERSION)
    rows = rows.select(k, "r", ops.alias("ops"), version.alias("version"))
    rows = rows.withColumn("error", patch.error(F.col("r"), F.col("ops"), S["Basket"], S, F.col("version")))
    made = F.when(F.col("error") == "", patch.apply(F.col("r"), F.col("ops"), S["Basket"], S, version=F.col("version")))
    rows = rows.select(k, "error", made["Lines"].alias("made"))
    return rows.select(k.alias("o_orderkey"), "error", F.when(F.col("made").isNotNull(), F.size("made")).alias("n_lines"), F.when(k % 6 == 5, F.element_at("made", -1)["Quantity"]).alias("last"))


@query(f"""WITH {SPARSE}, z AS (SELECT *, 8 + CASE WHEN c_custkey <> 0 THEN 16 ELSE 0 END + CASE WHEN c_name <> '' THEN 8 + (strlen(c_name) + 7) // 8 * 8 ELSE 0 END + CASE WHEN c_nationkey <> 0 THEN 8 ELSE 0 END AS place FROM s)
  SELECT c_custkey, CAST(CASE WHEN c_acctbal <> 0 THEN place ELSE 0 END AS BIGINT) AS acctbal_at, CAST(CASE WHEN c_acctbal <> 0 THEN 16 ELSE 0 END AS BIGINT) AS acctbal_size,
  CAST(CASE WHEN c_mktsegment <> '' THEN place + CASE WHEN c_acctbal <> 0 THEN 16 ELSE 0 END ELSE 0 END AS BIGINT) AS segment_at, c_mktsegment AS segment FROM z""")
def field_offsets(spark, sf_dir):
    """Where fields lie; the segment is read from the encoded record at its place."""
    rows = sparse_customers(spark, sf_dir)
    r = F.struct("*")
    places = {name: presence.field_place(r, S["Customer"], S, name) for name in ("Acctbal", "Mktsegment")}
    rows = rows.select("*", *[p[x].alias(f"{name}_{x}") for name, p in places.items() for x in ("offset", "size")], F.octet_length("Mktsegment").alias("n"))
    made = binary.encode_records(rows, SHOP, "Customer", keep=("Acctbal_offset", "Acctbal_size", "Mktsegment_offset", "n", "Custkey"))
    raw = F.substr("record", (F.col("Mktsegment_offset") + 9).cast("int"), "n").cast("string")
    return made.select(F.col("Custkey").alias("c_custkey"), F.col("Acctbal_offset").alias("acctbal_at"), F.col("Acctbal_size").alias("acctbal_size"), F.col("Mktsegment_offset").alias("segment_at"), F.when(F.col("n") > 0, raw).otherwise("").alias("segment"))


def _le_bytes(x: str, width: int) -> str:
    h = f"printf('%016x', CAST({x} AS BIGINT))"
    return "upper(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 15 - 2 * width, -2)) + ")"


@query(f"""SELECT o_orderkey, {_le_bytes('o_custkey', 8)} AS wide, {_le_bytes('o_custkey', 4)} AS four, {_le_bytes('o_orderkey % 256', 1)} AS one, CASE WHEN o_custkey <= 65535 THEN {_le_bytes('o_custkey', 2)} END AS two,
  -CAST(o_custkey AS BIGINT) AS back, CAST(o_orderkey % 256 AS SMALLINT) AS small, o_orderkey % 2 = 1 AS odd FROM orders""")
def fixed_width_numbers(spark, sf_dir):
    """Integers and bools put as little-endian bytes, null where they do not fit, and got again with their sign."""
    rows = orders(spark, sf_dir).select(F.col("Orderkey").alias("o_orderkey"), F.col("Custkey").cast("long").alias("c"))
    k, c = F.col("o_orderkey"), F.col("c")
    low = (k % 256).cast("long")
    put, get = presence.put_little_endian, presence.get_little_endian
    return rows.select(
        "o_orderkey", F.hex(put(c, "int64")).alias("wide"), F.hex(put(c, "uint32")).alias("four"), F.hex(put(low, "uint8")).alias("one"), F.hex(put(c, "uint16")).alias("two"),
        get(put(-c, "int64"), "int64").alias("back"), get(put(low, "uint8"), "uint8").alias("small"), get(put(k % 2 == 1, "bool"), "bool").alias("odd"),
    )
