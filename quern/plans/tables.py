"""The driver's tables as typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.schema import Enum, Schema, parse

SHOP: Schema = parse("""package shop

struct Line {
    Linenumber int32 @0
    Partkey int64 @1
    Suppkey int64 @2
    Quantity float64 @3
    Price float64 @4
}

struct Nation {
    Nationkey int32 @0
    Name string @1
    Regionkey int32 @2
}

struct Region {
    Regionkey int32 @0
    Name string @1
}

struct Order {
    Orderkey int64 @0
    Custkey int64 @1
    Status string @2
    Totalprice float64 @3
    Priority string @4
}

struct Basket {
    Orderkey int64 @0
    Status string @1
    Lines []Line @2
}

struct Amounts {
    Orderkey int64 @0
    Quantities []float64 @1
}

struct Customer {
    Custkey int64 @0
    Name string @1
    Nationkey int32 @2
    Acctbal float64 @3
    Mktsegment string @4
}

struct Resident {
    Custkey int64 @0
    Name string @1
    Home Nation @2
}

struct Turn {
    Conv int64 @0
    Turn int64 @1
    Role string @2
    Text string @3
}

struct Words {
    Doc int64 @0
    Words []string @1
    Lengths []int32 @2
    Flags []bool @3
}
""")
#: Priorities as an enum; its names are the table's.
PRIORITY = Enum("Priority", "uint8", {"": 0, "1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Orderkey"), F.col("o_custkey").alias("Custkey"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("Totalprice"), F.col("o_orderpriority").alias("Priority"))


def edited_orders(df: DataFrame) -> DataFrame:
    """A later snapshot: some statuses, prices and priorities change, some orders go."""
    k = F.col("Orderkey")
    return df.where(k % 17 != 0).select(
        "Orderkey", "Custkey",
        F.when(k % 7 == 0, "F").otherwise(F.col("Status")).alias("Status"),
        F.when(k % 11 == 0, F.col("Totalprice") + 1).otherwise(F.col("Totalprice")).alias("Totalprice"),
        F.when(k % 13 == 0, "").otherwise(F.col("Priority")).alias("Priority"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Custkey"), F.col("c_name").alias("Name"), F.col("c_nationkey").alias("Nationkey"), F.col("c_acctbal").alias("Acctbal"), F.col("c_mktsegment").alias("Mktsegment"))


def sparse_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of whom some fields are zero."""
    k = F.col("Custkey")
    return customers(spark, sf_dir).withColumn("Acctbal", F.when(k % 5 == 0, 0.0).otherwise(F.col("Acctbal"))).withColumn("Mktsegment", F.when(k % 3 == 0, "").otherwise(F.col("Mktsegment")))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orderkey and Lines (array of struct, by line number; ties by the other columns)."""
    line = F.struct(F.col("l_linenumber").alias("Linenumber"), F.col("l_partkey").alias("Partkey"), F.col("l_suppkey").alias("Suppkey"), F.col("l_quantity").alias("Quantity"), F.col("l_extendedprice").alias("Price"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("Orderkey")).agg(F.array_sort(F.collect_list(line)).alias("Lines"))


#: DuckDB: (k, q) with q the quantities of an order in the same order.
LISTS = "SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS q FROM lineitem GROUP BY 1"
