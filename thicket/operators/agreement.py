"""Agreement of two partitions of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): nodes labelled in both, by their two labels."""
    both = a.select("id", F.col("comm").alias("a")).join(b.select("id", F.col("comm").alias("b")), "id")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def _sums(a: DataFrame, b: DataFrame, value) -> DataFrame:
    """One row: n, and value summed over cells, a's and b's communities."""
    cells = contingency(a, b)
    one = lambda df, k: df.agg(F.coalesce(F.sum(value(F.col("n").cast("double"))), F.lit(0.0)).alias(k), F.count("*").alias(f"k{k}"))
    rows, columns = (cells.groupBy(k).agg(F.sum("n").alias("n")) for k in "ab")
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).crossJoin(one(cells, "ab")).crossJoin(one(rows, "a")).crossJoin(one(columns, "b"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mutual information over the mean entropy, natural logarithm; 1 if both have one community, null without
    common nodes."""
    s = _sums(a, b, lambda n: n * F.log(n))
    h = lambda k: F.log("n") - F.try_divide(F.col(k), F.col("n"))
    mutual = h("a") + h("b") - h("ab")
    value = F.when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * mutual, h("a") + h("b")), F.lit(0.0)))
    return s.select(F.when(F.col("n") > 0, F.greatest(F.lit(0.0), value)).alias("nmi"))


def ari(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: adjusted Rand index; 1 where it is undefined because the partitions are trivially equal, null without nodes."""
    s = _sums(a, b, lambda n: n * (n - 1) / 2)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    expected = F.coalesce(F.try_divide(F.col("a") * F.col("b"), pairs), F.lit(0.0))
    top, most = F.col("ab") - expected, (F.col("a") + F.col("b")) / 2 - expected
    return s.select(F.when(F.col("n") > 0, F.coalesce(F.try_divide(top, most), F.lit(1.0))).alias("ari"))
