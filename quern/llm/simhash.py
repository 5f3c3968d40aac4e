"""SimHash near-duplicates: 64-bit fingerprints linked by a generalised pigeonhole search.

The 64 bits are grouped into parts, correlated bits together.  If two
fingerprints differ in at most r bits and the parts' thresholds t sum, each plus
one, to r + 1, some part differs in at most its t bits; a threshold of -1 leaves
a part out.  Thresholds are chosen by dynamic programming on the candidate
counts that a bounded sample of fingerprints predicts: the choice changes cost,
never the result.  Each candidate is verified on all 64 bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, numbered, session_of, spread, stored

#: Fingerprints that the driver samples to plan the search.
SAMPLE = 3000
#: Parts that the planner may cut the bits into; wide radii need more.
PARTS = (3, 4, 5)


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of each run of ``shingle`` words; fewer words are one run, no words none."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Bits set in over half of the shingles' XXH64; repeats count; no words: zero."""
    return bits_of(np.array(shingle_hashes((text or b"").lower().split(), shingle), np.uint64))


def bits_of(h: np.ndarray) -> int:
    """Bits set in over half of the hashes ``h``; zero if there are none."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    def scan(batches):
        for batch in batches:
            prints = pa.array([fingerprint(t, shingle) for t in batch["_text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c for c, x in zip(batch.columns, batch.schema.names, strict=True) if x != "_text"], prints], names=[*[x for x in batch.schema.names if x != "_text"], "_print"])

    return scan


def plan(sample: np.ndarray, radius: int, total: int) -> list[tuple[int, int]]:
    """[(mask, threshold)] of the parts to probe: at most one bit a part, so wide radii take more parts."""
    if not 0 <= radius < 64:
        raise ValueError(f"no plan for fingerprints that differ in {radius} of 64 bits")
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((0, 64))
    varied = bits.std(0) > 0 if len(bits) > 1 else np.zeros(64, bool)
    alike = np.zeros((64, 64))
    if varied.sum() > 1:
        alike[np.ix_(varied, varied)] = np.abs(np.corrcoef(bits[:, varied], rowvar=False))
    np.fill_diagonal(alike, 0)
    a, b = np.triu_indices(len(sample), 1)
    apart = (sample.view(np.uint64)[a] ^ sample.view(np.uint64)[b]) if len(a) else np.zeros(1, np.uint64) + np.uint64(2**64 - 1)
    best: tuple[float, list] = (np.inf, [])
    for m in PARTS if radius < 2 * max(PARTS) else sorted({radius // 2 + 1, radius + 1}):
        left, groups = set(range(64)), []
        for k in range(m):
            width = (64 - sum(map(len, groups))) // (m - k)
            seed = max(sorted(left), key=lambda x: alike[x, sorted(left)].sum())
            group = [seed]
            left.remove(seed)
            while len(group) < width:
                near = max(sorted(left), key=lambda x: alike[x, group].sum())
                group.append(near)
                left.remove(near)
            groups.append(group)
        masks = [sum(1 << x for x in g) for g in groups]
        cost = []
        for g, mask in zip(groups, masks, strict=True):
            far = np.bitwise_count(apart & np.uint64(mask))
            # candidates by the sample's share of pairs, and one probe row for every key in reach
            cost.append([0.0] + [((far <= t).mean() + 0.5 / len(apart)) * total**2 / 2 + total * (1 + (len(g) if t else 0)) for t in range(min(radius, 1) + 1)])
        state = {0: (0.0, [])}
        for c in cost:
            nxt: dict[int, tuple[float, list]] = {}
            for need, (so_far, chosen) in state.items():
                for t, x in enumerate(c):
                    to = min(radius + 1, need + t)
                    if to not in nxt or so_far + x < nxt[to][0]:
                        nxt[to] = (so_far + x, [*chosen, t - 1])
            state = nxt
        if radius + 1 in state and state[radius + 1][0] < best[0]:
            best = (state[radius + 1][0], [(mask, t) for mask, t in zip(masks, state[radius + 1][1], strict=True) if t >= 0])
    if not best[1]:
        raise ValueError(f"no plan for radius {radius}")
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _places(prints: DataFrame, parts: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(index, probe): (part, key, fp) where each fingerprint lies, and where it looks for others."""
    index, probe = [], []
    for i, (mask, threshold) in enumerate(parts):
        key = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        index.append(prints.select("*", F.lit(i).alias("part"), key.alias("key")))
        flips = [F.lit(0).cast("long"), *[F.lit(signed(1 << x)) for x in range(64) if mask >> x & 1]]
        probe.append(prints.select("*", F.lit(i).alias("part"), F.explode(F.array(*[key.bitwiseXOR(x) for x in flips])).alias("key")) if threshold else index[-1])
    return reduce(DataFrame.union, index), reduce(DataFrame.union, probe)


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(u, v): pairs of the distinct ``prints`` (column fp) that differ in 1 to ``radius`` bits.

    Not all of them, but what all of them connect these connect too: every
    fingerprint is compared with one leader of each bucket that it probes, and
    what that links needs no pairs of its own.  After that only fingerprints of
    different components meet, bucket by bucket, so a bucket of thousands of
    near ones costs one comparison each.
    """
    sample = np.array([r.fp for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    parts = plan(sample, radius, prints.count())
    on = ["part", "key"]

    def near(a: str, b: str):
        return (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius)

    index, probe = _places(prints.select("fp"), parts)
    lead = stored(index.groupBy(*on).agg(F.min(F.struct(F.xxhash64("fp").alias("x"), "fp")).alias("l")).select(*on, F.col("l.fp").alias("v")))
    first = stored(probe.withColumnRenamed("fp", "u").join(lead, on).where(near("u", "v")).select("u", "v").distinct())
    known = stored(prints.select("fp").join(components(first), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("c")))
    index, probe = _places(known, parts)
    index = index.select(*on, F.col("fp").alias("v"), F.col("c").alias("d"))
    # of each bucket its largest component, with the bits that all of its fingerprints, and that any of them, have
    groups = index.groupBy(*on, "d").agg(F.count("*").alias("n"), F.bit_and("v").alias("all"), F.bit_or("v").alias("any"))
    main = stored(groups.groupBy(*on).agg(F.max(F.struct("n", "d", "all", "any")).alias("l")).select(*on, F.col("l.d").alias("main"), "l.all", "l.any"))
    probe = probe.withColumnRenamed("fp", "u")
    # a fingerprint that differs from all of them in too many of the bits they share is near none
    shared = F.bitwise_not(F.col("all").bitwiseXOR(F.col("any")))
    within = F.bit_count(F.col("u").bitwiseXOR(F.col("all")).bitwiseAND(shared)) <= radius
    index = index.join(main.select(*on, F.col("main").alias("most")), on)
    apart = probe.join(main, on).where((F.col("c") != F.col("main")) & within).join(index.where("d = most"), on).where(near("u", "v"))
    stray = probe.join(index.where("d <> most"), on).where((F.col("c") != F.col("d")) & near("u", "v"))
    return first.union(apart.select("u", "v")).union(stray.select("u", "v")).distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint and component of every row of ``docs``: doc_id, fp (long), component_id.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; the
    fingerprint is over ``shingle``-word shingles.  Fingerprints within
    ``radius`` bits link, equal ones always; component_id is the smallest
    doc_id reachable, itself included, null only if all ids of a component are.
    Null and blank texts have fingerprint zero and link like any other; rows
    that repeat an id stay rows; an empty table gives no rows; other columns
    are ignored.
    """
    session_of(docs)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")))
    found = stored(rows.mapInArrow(_fingerprints(shingle), "doc_id long, _print long").withColumnRenamed("_print", "fp"))
    prints = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(prints.select("fp"), radius))
    grouped = prints.join(groups, prints.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "component").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group of fingerprints that ``radius`` bits link: the one of the smallest doc_id.

    Of rows that share that id one stays; a group without any id keeps one row.
    Null and blank texts are one group; texts of any length count whole; an
    empty table stays empty.  Columns and texts are unchanged.
    """
    session_of(docs)
    rows = numbered(docs, "__quern_row")
    row = rows.select(F.col("__quern_row").alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))
    found = stored(spread(row).mapInArrow(_fingerprints(shingle), "_row long, _id long, _print long"))
    prints = stored(found.groupBy("_print").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")).alias("least")))
    groups = components(links(prints.select(F.col("_print").alias("fp")), radius))
    return first_of_groups(rows, prints.withColumnRenamed("_print", "key"), groups)


def first_of_groups(rows: DataFrame, keys: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of ``rows`` (numbered in __quern_row) that comes first in each group of ``keys`` (key, least: null id, id and row)."""
    best = keys.join(groups, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("component", "key").alias("c")).agg(F.min("least").alias("least"))
    return rows.join(best.select(F.col("least._row").alias("__quern_row")), "__quern_row", "left_semi").drop("__quern_row")
