"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies: target
size / source size.  Its whole part is taken outright; the fraction is a mass
between 0 and the document's size.  Two fractional documents move mass from one
to the other, at random but without bias, until one has none or all of its size;
the other goes on to the next.  A bucket of documents ends with one residual;
residuals meet in buckets of the next level of a tree until a source has one.
That last one is cut at a word: mass is only moved, so each source takes its
target within one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small, stored

#: Documents that one bucket of the reduction tree folds.
FAN_IN = 64
#: How often a document may be taken at most.
MOST = 3.0


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with ``rank``: 0-based place by code point, null last, without a single-task sort.

    Rows are range-partitioned and stored; a partition's first rank is the
    count of rows in those before it.
    """
    placed = sources.select(F.col(key).isNull().alias("_null"), *sources.columns).repartitionByRange(F.col("_null"), F.col(key)).sortWithinPartitions("_null", key)
    placed = stored(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = placed.groupBy("_part").count()
    before = counts.alias("a").join(F.broadcast(counts.alias("b")), F.expr("b._part < a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*sources.columns, (F.col("_before") + F.col("_at")).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = MOST) -> DataFrame:
    """Target of each source: ``sizes`` (source, n, source_size) gains weight and target.

    ``share`` of all sizes is divided by weight; a target stops at ``most``
    times its source's size and the excess is divided again among the others,
    until none is above.  The driver sees three sums a round.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(ranked(sizes, "source").withColumn("weight", w).drop("rank"))
    full = F.col("source_size") * F.lit(most)
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = None, -1
    while True:
        # a source is full if its cap is at or below what the present level gives it
        is_full = F.lit(False) if level is None else full <= F.col("weight") * level
        x = rows.agg(F.sum(F.when(is_full, full).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))), F.count_if(is_full)).first()
        if level is not None and x[2] == capped or not x[1]:
            break
        level, capped = (total - x[0]) / x[1], x[2]
    goal = full if level is None else F.least(full, F.col("weight") * F.lit(float(level)))
    return rows.withColumn("target", F.when(F.col("source_size") > 0, goal).otherwise(0.0))


def uniform(level: int, *of: str) -> Column:
    """A random number in [0, 1) that is a function of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit("pivot"), *[F.col(c) for c in of]), 11).cast("double") * F.lit(2.0**-53)


def fold(bucket: str) -> str:
    """SQL: (done array, rest item) of an array of items (doc_id, h, size, whole, mass, u, row), folded from the left."""
    up = "x.u * (least(a.rest.size - a.rest.mass, x.mass) + least(a.rest.mass, x.size - x.mass)) < least(a.rest.mass, x.size - x.mass)"
    fills, empties = "a.rest.size - a.rest.mass <= x.mass", "a.rest.mass <= x.size - x.mass"

    def item(of: str, mass: str) -> str:
        return f"named_struct('doc_id', {of}.doc_id, 'h', {of}.h, 'size', {of}.size, 'whole', {of}.whole, 'mass', {mass}, 'u', {of}.u, 'row', {of}.row)"

    def step(done: str, rest: str) -> str:
        return f"named_struct('done', concat(a.done, array({done})), 'rest', {rest})"

    cases = f"""CASE WHEN {up} THEN
        CASE WHEN {fills} THEN {step(item('a.rest', 'a.rest.size'), item('x', 'x.mass - (a.rest.size - a.rest.mass)'))}
             ELSE {step(item('x', '0D'), item('a.rest', 'a.rest.mass + x.mass'))} END
      ELSE
        CASE WHEN {empties} THEN {step(item('a.rest', '0D'), item('x', 'x.mass + a.rest.mass'))}
             ELSE {step(item('x', 'x.size'), item('a.rest', 'a.rest.mass - (x.size - x.mass)'))} END
      END"""
    return f"aggregate(slice({bucket}, 2, size({bucket})), named_struct('done', slice({bucket}, 1, 0), 'rest', {bucket}[0]), (a, x) -> {cases})"


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = MOST) -> DataFrame:
    """Words that a mix takes of each document.

    One row per row of ``docs``: row (its number, see ``numbered``), doc_id, source, size (words), source_size,
    target (of its source), taken (words, repeats counted), copies (taken /
    size).  A document is taken whole times or, one a source, cut at a word;
    never more than ``most`` times its size.  Null and empty texts have size 0
    and take 0; null is a source of its own; repeated rows are rows of their
    own; an empty table gives no rows.  Choices are functions of doc_id and
    text, so reruns agree.
    """
    # cut to these columns and kept apart from clashing names before rows are numbered
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")))
    return _mix(rows, "text", "source", "doc_id", weights, share, most)


def _mix(numbered_docs: DataFrame, text: str, source: str, doc_id: str, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``mix_sources`` of rows that have their number in ``row``."""
    rows = stored(
        numbered_docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(doc_id), F.col(text)).alias("h"),
            "row",
        )
    )
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights, share, most).select("source", "n", "source_size", "target"))
    count, largest = goals.agg(F.count("*"), F.max("n")).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = rows.withColumnRenamed("source", "_s").join(small(goals, count), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    joined = joined.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    mass = (F.col("rate") - F.col("whole")) * F.col("size")
    is_open = (F.col("size") > 0) & (F.col("rate") > F.col("whole"))
    shown = ["row", "doc_id", "source", "size", "source_size", "target"]
    out = joined.where(~is_open).select(*shown, (F.col("whole") * F.col("size")).cast("long").alias("taken"))
    # items carry what the fold needs; bucket keys carry the source's facts
    level, most_items = 0, largest or 0
    items = joined.where(is_open).select("source", "source_size", "target", F.col("n").alias("left"), F.struct("doc_id", "h", F.col("size").cast("double").alias("size"), "whole", mass.alias("mass"), uniform(0, "h", "doc_id").alias("u"), "row").alias("item"))
    key = ["source", "source_size", "target", "left"]
    while True:
        buckets = F.ceil(F.col("left") / FAN_IN)
        bucket = F.pmod(F.xxhash64(F.lit(level), "item.h", "item.doc_id"), buckets)
        grouped = items.groupBy(*key, bucket.alias("bucket")).agg(F.array_sort(F.collect_list("item")).alias("b"))
        folded = stored(grouped.select(*key, F.expr(fold("b")).alias("f")))
        last = most_items <= FAN_IN
        done = folded.select(*key, F.explode("f.done").alias("x"))
        out = out.union(_taken(done, shown))
        items = folded.select("source", "source_size", "target", F.ceil(F.col("left") / FAN_IN).alias("left"), "f.rest")
        if last:
            return out.union(_taken(items.withColumnRenamed("rest", "x"), shown)).withColumn("copies", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))
        level, most_items = level + 1, -(-most_items // FAN_IN)
        u = uniform(level, "rest.h", "rest.doc_id")
        items = items.select(*key, F.col("rest").withField("u", u).alias("item"))


def _taken(rows: DataFrame, shown: list[str]) -> DataFrame:
    return rows.select(
        F.col("x.row").alias("row"), F.col("x.doc_id").alias("doc_id"), "source", F.col("x.size").cast("long").alias("size"), "source_size", "target", (F.col("x.whole") * F.col("x.size") + F.round("x.mass")).cast("long").alias("taken")
    ).select(*shown, "taken")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns and mix_size, mix_taken, mix_copies.

    Its columns of these three names, if any, are replaced.  Null and empty
    texts are never taken; repeated rows are taken or left one by one; texts of
    any length stay whole.
    """
    docs = docs.drop("mix_size", "mix_taken", "mix_copies")
    rows = numbered(docs, "__quern_row")
    chosen = _mix(rows.select(F.col("__quern_row").alias("row"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id")), "text", "source", "doc_id", weights, share, most).where("taken > 0")
    chosen = chosen.select(F.col("row").alias("__quern_row"), F.col("size").alias("mix_size"), F.col("taken").alias("mix_taken"), F.col("copies").alias("mix_copies"))
    return rows.join(chosen, "__quern_row").drop("__quern_row")
