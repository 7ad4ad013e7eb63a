"""Row numbers and running totals over a whole table without gathering it in one task.

The table is range-partitioned on the order and written, so that partitions are fixed; each partition's total, one number a
partition, gives the next ones' offset; within partitions a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import once, stored


#: Rows that one task sorts.
ROWS = 1 << 20


def parts_of(rows: int, spark: SparkSession) -> int:
    """Partitions for so many rows: of ROWS at most, but as many as a shuffle has at least, so that a task's memory doesn't grow
    with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def running_total(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """df with ``name``: the sum of value over all rows before each row in the order, whose columns must tell rows apart."""
    df = once(df, "rows")  # it is counted, sampled and written
    n = parts_of(df.count(), df.sparkSession)
    parts = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    at = 0
    offsets = []
    for r in parts.groupBy("_part").agg(F.sum(value).alias("total")).orderBy("_part").collect():  # a row per partition
        offsets.append((r["_part"], at))
        at += r["total"] or 0
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    window = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = parts.repartition(n, "_part").withColumn("_within", F.coalesce(F.sum(value).over(window), F.lit(0)))
    return within.join(F.broadcast(shift), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with ``name``: 0, 1, ... in the order."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), "_one", order, name).drop("_one")
