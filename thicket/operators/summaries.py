"""Summaries of trial tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_std(trials: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key: x_mean and x_std (sample; null for one row) of each value."""
    return trials.groupBy(*keys).agg(*(f(v).alias(f"{v}_{k}") for v in values for k, f in (("mean", F.avg), ("std", F.stddev_samp))))


def with_baseline(summary: DataFrame, trials: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The summary with each key's constant columns of its trials."""
    return summary.join(trials.groupBy(key).agg(*(F.min(c).alias(c) for c in columns)), key)


def prediction_errors(trials: DataFrame, predicted: str, seen: str) -> DataFrame:
    """One row: mae, rmse, greatest error, percentage of equal signs."""
    e = F.col(seen) - F.col(predicted)
    same = F.when(F.signum(F.col(seen)) == F.signum(F.col(predicted)), 1.0).otherwise(0.0)
    return trials.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_error"), (F.avg(same) * 100.0).alias("sign_percent"))


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + top * d or tiny)
        c = 1.0 + top / c or tiny
        out *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * (out - 1.0)


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation of n pairs under Student's t; null below three pairs."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return _beta_share((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: r, null without variance, p, its two-sided p-value, and n."""
    varied = (F.coalesce(F.var_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.var_pop(y), F.lit(0.0)) > 0)
    cov, spread = F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))
    one = rows.agg(F.when(varied, F.try_divide(cov, spread)).alias("r"), F.count("*").alias("n"))
    return one.select("r", F.udf(correlation_p, "double")("r", "n").alias("p"), "n")  # of one row


def across(rows: DataFrame, value: str) -> DataFrame:
    """One row: mean, population std, min, max, positives and rows."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(F.when(F.col(value) > 0, 1)).alias("positive"), F.count("*").alias("n"))


def favorable_means(trials: DataFrame, group: str, flag: str, value: str) -> DataFrame:
    """Groups whose mean flag is positive and others: how many, and the mean of their means of value."""
    g = trials.groupBy(group).agg(F.avg(flag).alias("flag"), F.avg(value).alias("value"))
    return g.groupBy((F.col("flag") > 0).alias("favorable")).agg(F.count("*").alias("groups"), F.avg("value").alias("mean_value"))


def best_by(trials: DataFrame, keys: list[str], metric: str, order: list[str], least: bool = False) -> DataFrame:
    """Of each key the row of the best metric; of equals the first in order."""
    from pyspark.sql.window import Window

    by = F.col(metric).asc() if least else F.col(metric).desc()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(by, *order))
    return trials.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def speedups(trials: DataFrame, sparsify: str = "t_sparsify", sparse: str = "t_leiden_sparse", original: str = "t_leiden_orig") -> DataFrame:
    """Trials with t_pipeline, speedup (1 if the pipeline takes 0), speedup of the detection alone and the sampling's share."""
    total = F.col(sparsify) + F.col(sparse)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    return trials.withColumn("t_pipeline", total).withColumn("speedup", ratio(F.col(original), total)).withColumn("speedup_leiden", ratio(F.col(original), F.col(sparse))).withColumn("sparsify_share", F.coalesce(F.try_divide(F.col(sparsify), total), F.lit(0.0)))


# The bounds of notes and buckets.


def quality_note(dq: Column) -> Column:
    return F.when(dq > 0, "improved").when(dq < -0.01, "degraded").otherwise("maintained")


def weight_bucket(weight: Column) -> Column:
    """How strongly an edge was drawn."""
    return F.when(weight > 1.5, "strong").when(weight > 0.7, "usual").otherwise("weak")


def extremes(rows: DataFrame, value: str, keys: list[str], most: int = 5, least: int = 3) -> DataFrame:
    """The rows of the largest and the smallest values, with ``end`` top or bottom; of equals the first by keys."""
    top = rows.orderBy(F.desc(value), *keys).limit(most).withColumn("end", F.lit("top"))
    return top.unionByName(rows.orderBy(F.asc(value), *keys).limit(least).withColumn("end", F.lit("bottom")))
