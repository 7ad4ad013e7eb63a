"""Small graphs: the karate club and generated shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Zachary's karate club (1977), a member's higher-numbered friends.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32], 3: [7, 12, 13],
    4: [6, 10], 5: [6, 10, 16], 6: [16], 8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33], 19: [33], 20: [32, 33], 22: [32, 33],
    23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33], 27: [33], 28: [31, 33], 29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33],
}
# Members of the first faction; the others are in the second.
FACTION = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 16, 17, 19, 21]


def edges_of(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")


def karate(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(edges, labels)."""
    labels = spark.createDataFrame([(i, 0 if i in FACTION else 1) for i in range(34)], "id long, comm long")
    return edges_of(spark, [(a, b) for a, row in KARATE.items() for b in row]), labels


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def star(spark: SparkSession, leaves: int) -> DataFrame:
    return spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))


def complete(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    return spark.range(first, first + n).select(F.col("id").alias("src"), F.explode(F.sequence("id", F.lit(first + n - 1).cast("long"))).alias("dst")).filter("src < dst")


def barbell(spark: SparkSession, clique: int, between: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): two cliques with a path of ``between`` nodes; labels are of the sides."""
    n = 2 * clique + between
    bridge = spark.range(clique - 1, clique + between).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = complete(spark, clique).unionByName(bridge).unionByName(complete(spark, clique, clique + between))
    return edges, spark.range(n).select("id", (F.col("id") >= F.lit(clique + (between + 1) // 2)).cast("long").alias("comm"))


def grid(spark: SparkSession, side: int) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): a lattice, labelled by its quadrants."""
    n = side * side
    nodes = spark.range(n)
    right = nodes.filter(F.col("id") % side < side - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = nodes.filter(F.col("id") < n - side).select(F.col("id").alias("src"), (F.col("id") + side).alias("dst"))
    half = side // 2
    comm = 2 * (F.floor(F.col("id") / side) >= half).cast("long") + (F.col("id") % side >= half).cast("long")
    return right.unionByName(down), nodes.select("id", comm.alias("comm"))


def two_cliques_with_hub(spark: SparkSession) -> DataFrame:
    """Two cliques of four and a ninth node with two friends in each."""
    return complete(spark, 4).unionByName(complete(spark, 4, 4)).unionByName(edges_of(spark, [(8, 0), (8, 1), (8, 4), (8, 5)]))
