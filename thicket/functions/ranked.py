"""The first k rows of an order, and joins on keys of which some are very frequent, without gathering rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that rows are counted in, and rows whose keys the driver may sort itself.
BINS, FEW = 4096, 10_000
#: Keys that hold more than one of so many parts of all rows are frequent.
SHARES = 1000


def up_to(order: list[str], bound: tuple) -> Column:
    """Whether a row's columns come no later than bound, from the first column on."""
    *firsts, last = zip(order, bound, strict=True)
    at_last = F.col(last[0]) <= F.lit(last[1])
    return reduce(lambda rest, x: (F.col(x[0]) < F.lit(x[1])) | ((F.col(x[0]) == F.lit(x[1])) & rest), reversed(firsts), at_last)


def kth(df: DataFrame, order: list[str], k: int, bins: int = BINS, few: int = FEW) -> tuple | None:
    """The k-th row by numeric columns without null, which tell rows apart; None if there are fewer.  Rows are counted within
    ever smaller ranges of the first column, then of the next one where it is equal; nothing is sorted but a few rows."""
    pool, fixed = df.select(*order), ()
    for i, key in enumerate(order):
        low, high, n = pool.agg(F.min(key), F.max(key), F.count("*")).first()
        if k > n or k < 1:
            return None
        while True:
            if n <= few:
                return fixed + tuple(sorted(tuple(r)[i:] for r in pool.collect())[k - 1])
            if low == high:
                break
            step = (high - low) / bins if isinstance(low, float) else (high - low) // bins + 1
            if isinstance(low, float) and low + step == low:
                at = (F.col(key) > low).cast("int")
            else:
                at = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(step)).cast("int"))
            counts = pool.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("at").collect()
            for r in counts:  # a row a bin
                if k <= r["n"]:
                    low, high, n = r["low"], r["high"], r["n"]
                    break
                k -= r["n"]
            pool = pool.filter((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))
        fixed += (low,)
    return fixed


def first_k(df: DataFrame, order: list[str], k: int, bins: int = BINS, few: int = FEW) -> DataFrame:
    """The first k rows by numeric columns, or all if there are fewer: a filter, for df is read several times."""
    if k < 1:
        return df.filter(F.lit(False))
    bound = kth(df, order, k, bins, few)
    return df if bound is None else df.filter(up_to(order, bound))


def keyed_join(rows: DataFrame, table: DataFrame, key: str, total: int, spread: list[str], least: int = 64, how: str = "inner") -> DataFrame:
    """rows joined with table(key, count, ...), whose count is about how many rows a key has and total the sum of them; how is
    inner or left.

    Keys that have more than one of SHARES parts of all rows are SHARES at most: they are broadcast, and their rows are dealt
    by it and the columns spread.  So no key's rows meet in one task.  Columns of the two but the key must differ.
    """
    limit = max(least, total // SHARES)
    columns = [c for c in table.columns if c != key]
    hot = table.filter(F.col("count") > limit).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_{c}") for c in columns))
    told = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    told = told.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(key, *spread)))
    both = told.join(table.filter(F.col("count") <= limit).withColumnRenamed(key, "_key"), "_key", "left")
    out = both.select(*rows.columns, *(F.when(F.col("_hot").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns))
    return out if how == "left" else out.filter("count IS NOT NULL")
