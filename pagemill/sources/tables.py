"""The domain tables that the queries read, from the Parquet tables of a folder.

Users are customers, library items are orders (archived: status P), progress is
an order's line items, books are parts, session events are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.timing import millis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item_id"), millis(F.col("o_orderdate")).alias("added_ms"), (F.col("o_orderstatus") == "P").alias("archived"), F.col("o_orderpriority").alias("priority"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"))
    return rows.agg(F.floor(F.count_if(F.col("l_linestatus") == "F") * 100 / F.count("*")).cast("long").alias("pct"), millis(F.max("l_shipdate")).alias("read_ms"))


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's shelf: market segment in a nation."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("sort_order"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("shelf"))


#: The same tables in SQL, for the queries' SQL.
SQL = {
    "items": "items AS (SELECT o_custkey AS user_id, o_orderkey AS item_id, (epoch_us(o_orderdate) // 1000) AS added_ms, o_orderstatus = 'P' AS archived, o_orderpriority AS priority FROM orders)",
    "progress": "progress AS (SELECT l_orderkey AS item_id, CAST(floor(count(*) FILTER (WHERE l_linestatus = 'F') * 100 / count(*)) AS BIGINT) AS pct, (epoch_us(max(l_shipdate)) // 1000) AS read_ms FROM lineitem GROUP BY 1)",
    "shelves": "shelves AS (SELECT c_custkey AS user_id, c_nationkey AS sort_order, c_nationkey || '/' || c_mktsegment AS shelf FROM customer)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
