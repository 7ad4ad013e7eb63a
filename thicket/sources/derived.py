"""Graphs that the relational tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import parts_of
from ..operators.edges import canonical


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item: its customer (key * 10 + 1) and supplier (key * 10 + 2)."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    both = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select((F.col("o_custkey") * 10 + 1).alias("src"), (F.col("l_suppkey") * 10 + 2).alias("dst"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(trade_pairs(spark, sf_dir))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers and suppliers, with nation and region."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_regionkey").cast("long").alias("region"))
    c = _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 10 + 1).alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    s = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10 + 2).alias("id"), F.col("s_nationkey").cast("long").alias("nation"))
    return c.unionByName(s).join(nations, "nation").select("id", "nation", "region")


def trade_labels(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    return trade_nodes(spark, sf_dir).select("id", F.col(by).alias("comm"))


def parts_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order; an order has few lines, so its pairs are few."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = parts_of(8 * items.count(), spark)  # a task holds its lines distinct, twice sorted, and two pairs for each
    items = items.repartition(n, "l_orderkey").distinct()
    a, b = items.select("l_orderkey", F.col("l_partkey").alias("src")), items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").filter("src < dst").select("src", "dst").repartition(n, "src", "dst").distinct()


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand; brands are numbered by the digits of their names."""
    part = _table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("comm"))
