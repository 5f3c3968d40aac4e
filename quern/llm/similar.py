"""Near-duplicates of a real similarity: SimHash finds the nearest, an exact set-similarity join completes them.

Texts link if the Jaccard similarity of their distinct word shingles is 0.8 or
more.  Fingerprints of such texts differ in up to 20 of 64 bits, more than any
pigeonhole plan can probe, so SimHash alone would miss most links.  Its
candidates at a small radius are verified and linked first; the rest follows
from two rules on sets of that similarity, n and m their sizes:

* In any common order of shingles they share k shingles among the first
  n - ceil(0.8 n) + k of each.  In the order of hashes, with k of about n / 20,
  this tells which texts can have a partner at all; in the order of rarity,
  with k = 1, it proposes pairs of those.
* One shared shingle stands so early in both that the shingles from it on can
  still make up the overlap, 4 (n + m) / 9.

Each pair is verified on whole sets, so none is missed and none is added.  A
large group is not compared pair by pair: each text is first compared with the
members of its buckets that have the fewest shingles of their own, as the
origin of edited copies does, and what those links connect needs no pairs.
That saves work, never a group: what stays apart is compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free, numbered, session_of, small, spread, stored
from .simhash import bits_of, first_of_groups, links, shingle_hashes

#: Bits that the fingerprints of candidates of the first pass differ in at most.
RADIUS = 2
#: Pairs of one text that one task verifies.
SHARE = 1000


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 (signed) of the shingles of ``text``; a text of fewer words is one shingle, one of none has none."""
    return np.unique(np.array(shingle_hashes((text or b"").lower().split(), shingle), np.uint64).view(np.int64))


def _key(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 7)], np.uint64).view(np.int64)[0])


def _reach(n: int) -> int:
    """First shingles of ``n`` among which a text of similarity 0.8 and size m shares 1 + min(n, m) // 20."""
    return n - (4 * n + 4) // 5 + 1 + n // 20 if n else 0


def _heads(shingle: int):
    def scan(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["_text"].to_pylist()]
            heads = [s[: _reach(len(s))] for s in sets]
            prints = [bits_of(s.view(np.uint64)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["_id"], pa.array(map(_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], names=["_row", "_id", "_key", "_n", "_print", "_head"])

    return scan


def _sets(shingle: int):
    def scan(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["s", "n", "grams"])

    return scan


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are similar; a text of many pairs is copied to several tasks."""
    often = stored(pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("k")))
    left = pairs.join(often, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("k")).cast("int").alias("salt"))
    left = left.join(sets.select(F.col("s").alias("u"), F.col("n").alias("nu"), F.col("grams").alias("gu")), "u")
    right = sets.join(often, F.col("s") == F.col("v")).select("v", F.col("n").alias("nv"), F.col("grams").alias("gv"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    # i / (nu + nv - i) >= 0.8 in whole numbers
    similar = 9 * F.size(F.array_intersect("gu", "gv")) >= 4 * (F.col("nu") + F.col("nv"))
    return stored(left.join(right, ["v", "salt"]).where(similar).select("u", "v"))


def _buckets(sets: DataFrame) -> DataFrame:
    """(g, s, n, own, at): the buckets of each set, its shingles that no other set has, and the place of its first shingle in a bucket.

    Shingles that the same sets hold make one bucket.
    """
    grams = sets.select("s", "n", F.explode("grams").alias("h"))
    shared = stored(grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    by_set = Window.partitionBy("s")
    ranked = grams.join(shared, "h").withColumn("at", F.row_number().over(by_set.orderBy("df", "h"))).withColumn("own", F.col("n") - F.count("*").over(by_set))
    # a shingle of one set only comes first in the order of rarity and finds nothing
    index = stored(ranked.select("s", "n", "h", "own", (F.col("at") + F.col("own")).alias("at")).where("at <= n - (4 * n + 4) div 5 + 1"))
    sums = [F.sum(F.xxhash64("s", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    held = index.groupBy("h").agg(F.count("*").alias("c"), F.xxhash64(F.count("*"), *sums).alias("g")).where("c > 1")
    held = stored(held.select("h", "g"))
    out = stored(index.join(held, "h").groupBy("g", "s", "n", "own").agg(F.min("at").alias("at")))
    free(shared, index, held)
    return out


def _named(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """``buckets`` with the component ``c`` of each set."""
    return stored(buckets.join(components(edges), F.col("s") == F.col("node"), "left").select("g", "s", "n", "own", "at", F.coalesce("component", "s").alias("c")))


def _alike(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v): ``edges`` and links of ``sets`` (s, n, grams) whose components are those of all pairs of similarity 0.8 or more."""
    buckets = _buckets(sets)
    fits = "5 * least(n, m) >= 4 * greatest(n, m) and 9 * (least(n - at, m - at2) + 1) >= 4 * (n + m)"
    known = _named(buckets, edges)
    first = F.min(F.struct("own", F.xxhash64("s").alias("x"), "s", "n", "at", "c")).alias("l")
    lead = stored(known.groupBy("g").agg(first, (F.min("c") != F.max("c")).alias("mixed")).where("mixed").select("g", F.col("l.own").alias("own2"), F.col("l.s").alias("s2"), F.col("l.n").alias("m"), F.col("l.at").alias("at2"), F.col("l.c").alias("c2")))
    met = known.join(lead, "g").where(f"c <> c2 and {fits}")
    one = F.struct("own2", F.xxhash64("s2").alias("x"), "s2")
    chosen = met.groupBy("s").agg(F.min(one).alias("a"), F.max(one).alias("b"))
    edges = edges.union(_verified(stored(chosen.select(F.col("s").alias("u"), F.explode(F.array_distinct(F.array("a.s2", "b.s2"))).alias("v"))), sets))
    known = _named(buckets, edges)
    # what is left: pairs of different components, one of them outside its bucket's main component
    main = known.groupBy("g", "c").count().groupBy("g").agg(F.max(F.struct("count", "c")).alias("l"), F.count("*").alias("k")).where("k > 1").select("g", F.col("l.c").alias("main"))
    mixed = stored(known.join(stored(main), "g"))
    stray = mixed.where("c <> main").select("g", F.col("s").alias("s2"), F.col("n").alias("m"), F.col("at").alias("at2"), F.col("c").alias("c2"))
    pairs = mixed.join(stray, "g").where(f"c <> c2 and {fits}").select(F.least("s", "s2").alias("u"), F.greatest("s", "s2").alias("v")).distinct()
    return edges.union(_verified(stored(pairs), sets))


def similar_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the smallest doc_id.

    Texts of a Jaccard similarity of at least 0.8 over their distinct
    ``shingle``-word shingles are linked, groups are what links connect.  Texts
    are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; shingles are
    compared by 64-bit hashes.  Null and blank texts are one group; texts of
    fewer words are one shingle; texts of any length count whole; an empty table
    stays empty.  Of rows that share an id one stays; a group without any id
    keeps one row.  Columns and texts are unchanged.  ``radius`` of the
    fingerprint search changes cost, not the result.
    """
    session_of(docs)
    rows = numbered(docs, "__quern_row")
    row = rows.select(F.col("__quern_row").alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    found = stored(spread(row).mapInArrow(_heads(shingle), "_row long, _id long, _key long, _n long, _print long, _head array<long>"))
    keys = stored(found.groupBy(F.col("_key").alias("key")).agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")).alias("least"), F.max("_n").alias("n"), F.max("_print").alias("fp"), F.count("*").alias("copies")))
    heads = found.select("_key", F.explode("_head").alias("h"))
    paired = stored(heads.groupBy("h").agg((F.min("_key") != F.max("_key")).alias("two")).where("two").select("h"))
    # each copy of a set counts its shared shingles once; a partner has at least 0.8 n
    alive = heads.join(paired, "h").groupBy("_key").count().join(keys, F.col("_key") == F.col("key")).where("count >= copies * (1 + (4 * n + 4) div 5 div 20)")
    alive = stored(alive.select("key", "fp", F.col("least._row").alias("_row")))
    free(found, paired)
    sets = stored(row.join(small(alive.select("_row"), alive.count()), "_row", "left_semi").select("_text").mapInArrow(_sets(shingle), "s long, n long, grams array<long>"))
    # fingerprints first: near ones and equal ones
    near = links(stored(alive.select("fp").distinct()), radius)
    by_print = stored(alive.groupBy("fp").agg(F.min("key").alias("s")))
    same = alive.join(by_print, "fp").where("key <> s").select(F.col("key").alias("u"), F.col("s").alias("v"))
    close = near.join(by_print.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u").join(by_print.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    groups = components(_alike(sets, _verified(stored(same.union(close)), sets)))
    return first_of_groups(rows, keys, groups)
