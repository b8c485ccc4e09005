"""Registration of queries, and the tables they share: orders as items, suppliers and parts as members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, grp, year, cites, cust."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).alias("cites"), F.col("o_custkey").alias("cust"))


def members(spark: SparkSession, sf_dir: str, member: str = "l_suppkey") -> DataFrame:
    """Distinct (item, member)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col(member).alias("member")).distinct()


ITEMS = """items AS (SELECT o_orderkey AS item, o_orderpriority AS grp, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS cites, o_custkey AS cust FROM orders)"""
MEMBERS = "members AS (SELECT DISTINCT l_orderkey AS item, l_suppkey AS member FROM lineitem)"
PARTS = "parts AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS member FROM lineitem)"
PAIRS = (
    PARTS
    + """, teams AS (SELECT item, count(*) AS n FROM parts GROUP BY item),
pairs AS (SELECT x.member AS a, y.member AS b, count(*) AS w, sum(1.0 / (t.n - 1)) AS wn
  FROM parts x JOIN parts y ON x.item = y.item AND x.member < y.member JOIN teams t ON t.item = x.item GROUP BY x.member, y.member)"""
)
EDGES = PAIRS + ", edges AS (SELECT * FROM pairs WHERE w >= 2), both_ways AS (SELECT a AS x, b AS y, w FROM edges UNION ALL SELECT b, a, w FROM edges)"
