"""Shared plumbing: tables, scratch storage that all executors see, components."""

from __future__ import annotations

import atexit
import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.shipping import new_folder, shared_dir, ship

#: Rows of a lookup table up to which it may be broadcast (16-100 bytes a row).
BROADCAST_ROWS = 100_000

_scratch: list[str] = []


def session_of(df: DataFrame) -> SparkSession:
    """The session of ``df`` with Arrow batches small enough for long texts.

    A batch is bounded by rows here; 400 texts of 100 kB are 40 MB.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    shared_dir(spark)
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's switch for deleting the shuffle files of a query when it has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    The shuffle files that this took go at once, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _scratch:
        atexit.register(drop_scratch, spark)
    _scratch.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(*tables: DataFrame) -> None:
    """Delete what ``stored`` has written for ``tables``, of which all that later tables need is stored."""
    for df in tables:
        _scratch.remove(df._quern_path)
        _delete(df.sparkSession, df._quern_path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what ``stored`` has written; results that still read it become unreadable."""
    with contextlib.suppress(Exception):
        while _scratch:
            _delete(spark, _scratch.pop())


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it is smaller than what one task may read.

    A small file is one row group, which one task would read and work on alone.
    """
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < limit else df


#: Bits of a row number that count rows of one file.
ROW_BITS = 40


def _is_file_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a Parquet file, chosen and projected by functions of that row."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while True:
        name = plan.getClass().getSimpleName()
        if name == "LogicalRelation":
            relation = plan.relation()
            return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"
        if name not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a long column ``name`` that is another number for every row, and the same in every later job.

    Rows of Parquet files are numbered by file and place in it, so however a job
    splits the files, now or after executors came or went, a row keeps its
    number; nothing is written.  Any other input is stored once with its
    numbers, and the stored table is what is returned.
    """
    if not _is_file_scan(df):
        return stored(df.withColumn(name, F.monotonically_increasing_id()))
    meta = df.metadataColumn("_metadata")
    placed = df.select("*", meta["file_path"].alias("__quern_path"), meta["row_index"].alias(name))
    # the driver that lists the files can hold their names
    paths = sorted(r[0] for r in placed.select("__quern_path").distinct().collect())
    if len(paths) < 2:
        return placed.drop("__quern_path")
    files = df.sparkSession.createDataFrame([(p, i << ROW_BITS) for i, p in enumerate(paths)], "__quern_path string, __quern_base long")
    return placed.join(small(files, len(paths)), "__quern_path").withColumn(name, F.col(name) + F.col("__quern_base")).drop("__quern_path", "__quern_base")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within the bound, else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): (node, component), component the smallest node.

    Alternating large-star and small-star steps: every step is an aggregation
    with partial combine and an equi-join, so a hub's edges are never gathered
    in one task.  Edges are stored after each round; the loop ends when a round
    changes nothing.  Nodes without an edge are absent.  Null ends are dropped.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node keeps its smallest neighbour; the others and itself hang below that one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(star.where("u <> v").distinct())
        after = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
