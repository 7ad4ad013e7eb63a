"""What plots of trials show: the front of cost and quality, and straight lines through logarithms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _front(points: np.ndarray) -> np.ndarray:
    """Points (cost, quality) of which none costs less and is as good, or is better at the same cost; a point once."""
    points = points[np.lexsort((-points[:, 1], points[:, 0]))]
    best = np.maximum.accumulate(points[:, 1])
    return points[np.r_[True, points[1:, 1] > best[:-1]]] if len(points) else points


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    front = np.zeros((0, 2))
    for batch in batches:
        front = _front(np.concatenate([front, np.column_stack([batch.column(c).to_numpy() for c in ("cost", "quality")])]))
    yield pa.RecordBatch.from_arrays([pa.array(front[:, 0]), pa.array(front[:, 1])], names=["cost", "quality"])


def pareto(df: DataFrame, cost: str, quality: str) -> DataFrame:
    """The rows of df that no other row dominates: none costs as little and is as good, and either costs less or is better.  Rows
    that are equal in both stay together; rows with a null or NaN in either go.  Numbers are compared as doubles.

    Each task keeps the front of its rows; these meet in ranges of cost, and the best quality of the ranges before, one number a
    range, decides what remains of a range's front.
    """
    rows = df.select(F.col(cost).cast("double").alias("cost"), F.col(quality).cast("double").alias("quality")).filter("cost IS NOT NULL AND quality IS NOT NULL AND NOT isnan(cost) AND NOT isnan(quality)")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.mapInArrow(_local, "cost double, quality double").repartitionByRange(n, "cost").mapInArrow(_local, "cost double, quality double")
    parts = stored(local.withColumn("part", F.spark_partition_id()), "fronts")
    best, before = None, []
    for r in parts.groupBy("part").agg(F.max("quality").alias("best")).orderBy("part").collect():  # a row a range
        before.append((r["part"], best))
        best = r["best"] if best is None else max(best, r["best"])
    bound = df.sparkSession.createDataFrame(before, "part int, bound double")
    front = parts.join(F.broadcast(bound), "part").filter("bound IS NULL OR quality > bound").select(F.col("cost").alias("_cost"), F.col("quality").alias("_quality"))
    return df.join(front, (F.col(cost).cast("double") == F.col("_cost")) & (F.col(quality).cast("double") == F.col("_quality")), "left_semi")


def power_fit(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Of each group of keys, or of all rows: n, exponent, factor and r2 of ``y = factor * x ** exponent``, a straight line through the
    logarithms.  Only rows with both above 0 count; exponent, factor and r2 are null where fewer than two x differ."""
    logs = df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(*(keys or []), F.log(F.col(x).cast("double")).alias("_x"), F.log(F.col(y).cast("double")).alias("_y"))
    fit = logs.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("exponent"), F.exp(F.regr_intercept("_y", "_x")).alias("factor"), F.regr_r2("_y", "_x").alias("r2"))
    return fit if keys else fit.filter("n > 0")

