"""Embedding near-duplicates: a forest of random-projection trees with spill, verified in double precision.

The upper levels of each tree are fitted on a bounded sample: a level projects
on one random direction and splits a node at its median; vectors near the split
go to both sides.  A leaf that is still large is split again by a subtree
fitted on a bounded sample of its own, as often as that makes it smaller, so
leaves stay small at any number of vectors.  Every vector is indexed.  Leaves
hold ids; vectors join them for one comparison within each leaf and label.
Equal vectors are one class with a multiplicity, so copies cost nothing but a
count.

Two unit vectors of cosine 0.98 lie 0.2 apart, 0.2 / sqrt(dimension) along a
random direction in the root mean square.  With a zone of half that width
around each split, one in 75 such pairs is parted by a level; twenty levels of
four trees miss one in 300.  About a twelfth of all vectors lies in the zone;
where a cluster does, the split moves aside, or the node is not split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, session_of, small, stored

#: Vectors that fit the upper levels, or the subtree of one leaf, at most; vectors wanted in a leaf.
SAMPLE = 20_000
LEAF_SAMPLE = 4_000
LEAF = 400
#: Leaves of over LARGE x LEAF vectors are split again; leaves that resist are compared in blocks of so many rows.
LARGE = 4
BLOCK = 2_000
TREES = 4
#: Half the width of the zone that goes both ways, times the square root of the dimension.
SPILL = 0.1
#: Share of a node's vectors in the zone of its median from which another split is looked for, and from which it is not split.
DENSE, TOO_DENSE = 0.3, 0.5
#: Vectors that one task places in the subtree of a leaf.
SHARE = 50_000


class Tree:
    """One tree: node k has children 2k and 2k + 1, the root is 1; a level has one direction."""

    def __init__(self, seed: int, depth: int, dim: int, cuts: np.ndarray):
        self.depth, self.cuts = depth, cuts
        directions = np.random.default_rng(seed).standard_normal((depth, dim))
        self.directions = directions / np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-12)

    @classmethod
    def fit(cls, seed: int, sample: np.ndarray, total: int, leaf: int, spill: float) -> Tree:
        # as deep as leaves of the wanted size need, and as the sample can tell medians
        depth = max(0, int(np.floor(np.log2(max(min(total / leaf, len(sample) / 8), 1)))))
        tree = cls(seed, depth, sample.shape[1], np.zeros(1 << depth))
        p = sample @ tree.directions.T
        groups = {1: np.arange(len(sample))}
        for d in range(depth):
            nxt = {}
            for node, rows in groups.items():
                cut = tree.cuts[node] = _split(np.sort(p[rows, d]), spill)
                nxt[2 * node], nxt[2 * node + 1] = rows[p[rows, d] <= cut], rows[p[rows, d] > cut]
            groups = nxt
        return tree

    def leaves(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        p = x @ self.directions.T
        for d in range(self.depth):
            off = p[row, d] - self.cuts[node]
            left, right = off <= spill, off >= -spill
            row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
        return row, node


def _split(p: np.ndarray, spill: float) -> float:
    """The median of the sorted ``p``, unless a cluster lies there: then the emptiest zone between the tenths at the ends.

    Infinity, which sends all to the left, if every zone holds too many: a tight
    cluster would go both ways at every level.
    """
    if not len(p):
        return 0.0
    cuts = np.r_[np.median(p), (p[1:] + p[:-1])[len(p) // 10 : max(len(p) - len(p) // 10 - 1, 0)] / 2]
    inside = (np.searchsorted(p, cuts + spill, "right") - np.searchsorted(p, cuts - spill, "left")) / len(p)
    best = 0 if inside[0] < DENSE else int(inside.argmin())
    return float(cuts[best]) if inside[best] < TOO_DENSE else np.inf


def _unit(column, n: int) -> np.ndarray:
    """The list column's vectors, scaled to length one, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_PLACE = pa.schema([("cid", pa.int64()), ("at", pa.int64()), ("leaf", pa.int64())])


def _upper(model, spill: float):
    def place(batches):
        trees = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch["v"], batch.num_rows)
            for t, tree in enumerate(trees):
                row, leaf = tree.leaves(x, spill)
                yield pa.RecordBatch.from_arrays([batch["cid"].take(pa.array(row)), pa.array(np.full(len(row), t)), pa.array(leaf)], schema=_PLACE)

    return place


def _fit_leaf(leaf: int, spill: float):
    def fit(table: pa.Table) -> pa.Table:
        at = table["at"][0].as_py()
        tree = Tree.fit(at % (1 << 63), _unit(table["v"], len(table)), table["n"][0].as_py(), leaf, spill)
        return pa.table({"at": pa.array([at]), "depth": pa.array([tree.depth], pa.int32()), "cuts": pa.array([tree.cuts.tolist()], pa.list_(pa.float64()))})

    return fit


def _place_leaf(dim: int, spill: float):
    def place(rows: pa.Table, model: pa.Table) -> pa.Table:
        if not len(rows) or not len(model):
            return _PLACE.empty_table()
        at = rows["at"][0].as_py()
        tree = Tree(at % (1 << 63), model["depth"][0].as_py(), dim, np.array(model["cuts"][0].as_py()))
        row, leaf = tree.leaves(_unit(rows["v"], len(rows)), spill)
        return pa.table({"cid": rows["cid"].combine_chunks().take(pa.array(row)), "at": pa.array(np.full(len(row), at)), "leaf": pa.array(leaf)}, schema=_PLACE)

    return place


def _placements(own: DataFrame, dim: int, total: int, trees: int, leaf: int, spill: float, sample: int, leaf_sample: int) -> DataFrame:
    """(cid, code): the leaves of every vector of ``own`` (cid, v)."""
    spark = own.sparkSession
    picked = own.orderBy(F.xxhash64("v"), "cid").limit(sample).select("v").toArrow()
    s = _unit(picked["v"], len(picked))
    model = spark.sparkContext.broadcast([Tree.fit(71 + t, s, total, 2 * leaf, spill) for t in range(trees)])
    code = F.xxhash64("at", "leaf").alias("code")
    placed = stored(own.mapInArrow(_upper(model, spill), "cid long, at long, leaf long").select("cid", code, F.lit(total).cast("long").alias("was")))
    done, most = None, LARGE * leaf
    while True:
        sizes = placed.groupBy("code").agg(F.count("*").alias("n"), F.max("was").alias("was"))
        # a leaf that keeps nearly all of its parent is one tight cluster
        large = stored(sizes.where((F.col("n") > most) & (F.col("n") < 0.9 * F.col("was"))).select(F.col("code").alias("at"), "n"))
        count = large.count()
        if not count:
            return placed.select("cid", "code") if done is None else done.union(placed.select("cid", "code"))
        again = placed.withColumnRenamed("code", "at").join(small(large, count), "at")
        kept = placed.join(small(large.select(F.col("at").alias("code")), count), "code", "left_anti").select("cid", "code")
        done = kept if done is None else done.union(kept)
        rows = stored(again.select("cid", "at", "n").join(own, "cid"))
        share = F.pmod(F.xxhash64("cid", "at"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0) * leaf_sample / F.col("n"))
        model = rows.where(share).groupBy("at").applyInArrow(_fit_leaf(2 * leaf, spill), "at long, depth int, cuts array<double>")
        parts = F.ceil(F.col("n") / SHARE).cast("int")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("cid"), parts).cast("int"))
        models = model.join(small(large, count), "at").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        made = salted.groupBy("at", "salt").cogroup(models.groupBy("at", "salt")).applyInArrow(_place_leaf(dim, spill), "cid long, at long, leaf long")
        placed = stored(made.join(small(large, count), "at").select("cid", code, F.col("n").alias("was")))


def hooked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (each node's smallest known fellow) after linking i and j."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


def _compare(least: float):
    def compare(table: pa.Table) -> pa.Table:
        label, cid = table["label"].to_numpy(), table["cid"].to_numpy()
        order = np.lexsort((cid, label))
        label, cid = label[order], cid[order]
        x = _unit(table["v"], len(table))[order]
        m, chunk = table["m"].to_numpy()[order], table["chunk"].to_numpy()[order]
        here, low, high = (table[c][0].as_py() for c in ("code", "bi", "bj"))
        lists = table["codes"].combine_chunks()
        length = lists.value_lengths().to_numpy()
        width = int(length.max())
        codes = np.zeros((len(table), width), np.int64)
        used = np.arange(width) < length[:, None]
        codes[used] = lists.flatten().to_numpy()
        codes, used = codes[order], used[order]
        count, root = np.zeros(len(table), np.int64), np.arange(len(table))
        edges = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        for a, b in zip(edges, [*edges[1:], len(table)], strict=True):
            for at in range(a, b, 256):
                i, j = np.nonzero(x[at : min(at + 256, b)] @ x[at:b].T >= least)
                i, j = i + at, j + at
                keep = (i < j) & ((chunk[i] != chunk[j]) if low != high else True)
                i, j = i[keep], j[keep]
                for s in range(0, len(i), 100_000):
                    p, q = i[s : s + 100_000], j[s : s + 100_000]
                    # a pair counts only in the first leaf that both are in
                    first = np.full(len(p), np.iinfo(np.int64).max)
                    for k in range(width):
                        own = codes[p, k]
                        both = ((own[:, None] == codes[q]) & used[q]).any(1) & used[p, k]
                        first = np.where(both, np.minimum(first, own), first)
                    p, q = p[first == here], q[first == here]
                    count += np.bincount(p, m[q], len(table)).astype(np.int64) + np.bincount(q, m[p], len(table)).astype(np.int64)
                    root = hooked(root, p, q)
        hung = np.flatnonzero(root != np.arange(len(table)))
        some = np.flatnonzero(count)
        u, v, n = np.r_[cid[some], cid[hung]], np.r_[np.full(len(some), -1), cid[root[hung]]], np.r_[count[some], np.zeros(len(hung), np.int64)]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return compare


def embedding_dedup(rows: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", least: float = 0.98, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, leaf_sample: int = LEAF_SAMPLE) -> DataFrame:
    """Links and components of near-equal vectors of equal label.

    One row per row of ``rows``: vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id reachable, itself included), kept
    (it is that one).  Two vectors link if found and their cosine, in double
    precision, is ``least`` or more.  Vectors that are null, empty, zero or hold
    null or non-finite components, or whose label is null, link with nothing;
    vectors of different length never link; repeated rows are linked copies.
    Other columns are ignored; an empty table gives no rows.
    """
    session_of(rows)
    v = F.col(vector)
    fine = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    classes = base.where("fine").groupBy("label", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("lab", F.xxhash64(F.col("label").cast("string"))))
    found = None
    for dim, total in sorted((r[0], r[1]) for r in classes.groupBy(F.size("v")).count().collect()):
        own = classes.where(F.size("v") == dim).select("cid", F.col("lab").alias("label"), "m", "v")
        placed = _placements(own.select("cid", "v"), dim, total, trees, leaf, spill / dim**0.5, sample, leaf_sample)
        lists = placed.groupBy("cid").agg(F.array_distinct(F.collect_list("code")).alias("codes"))
        wide = own.join(lists, "cid").select("*", F.explode("codes").alias("code"))
        sizes = stored(placed.distinct().groupBy("code").count().where(F.col("count") > BLOCK))
        blocks = F.ceil(F.col("count") / BLOCK)
        chunk = F.when(F.col("count").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("cid"), blocks)).cast("int")
        cut = wide.join(small(sizes, sizes.count()), "code", "left").withColumn("chunk", chunk)
        cut = cut.withColumn("other", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (blocks - 1).cast("int")))))
        cut = cut.withColumn("bi", F.least("chunk", "other")).withColumn("bj", F.greatest("chunk", "other")).drop("count", "other")
        part = cut.groupBy("code", "bi", "bj").applyInArrow(_compare(least), "u long, v long, n long")
        found = part if found is None else found.union(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found)
    counts = found.where("n > 0").groupBy("u").agg(F.sum("n").alias("n"))
    groups = components(found.where("n = 0").select("u", "v"))
    named = classes.join(counts, classes.cid == counts.u, "left").join(groups, classes.cid == groups.node, "left")
    named = stored(named.select("label", "v", "least", "m", F.coalesce("component", "cid").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("label", "v", "n_links", "component_id")
    out = base.where("fine").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
