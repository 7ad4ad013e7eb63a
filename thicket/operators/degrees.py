"""Degrees and edge scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, d); with nodes(id), isolated ones have degree 0."""
    own = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return own if nodes is None else nodes.select("id").join(own, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("d").agg(F.count("*").alias("nodes"))


def with_scores(both: DataFrame) -> DataFrame:
    """Edges that have d_src and d_dst, with their score, and their degrees' product and sum."""
    score = F.lit(1.0) / F.col("d_src") + F.lit(1.0) / F.col("d_dst")
    return both.withColumns({"score": score, "d_product": F.col("d_src") * F.col("d_dst"), "d_sum": F.col("d_src") + F.col("d_dst")})


def scored(edges: DataFrame) -> DataFrame:
    """Edges with d_src, d_dst, score 1/d_src + 1/d_dst, their degrees' product and sum; edges that have these already stay as they are."""
    if "score" in edges.columns:
        return edges
    d = degrees(edges)
    both = edges.join(d.select(F.col("id").alias("src"), F.col("d").alias("d_src")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("d_dst")), "dst")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return with_scores(both.select("src", "dst", *rest, "d_src", "d_dst"))


def graph_size(edges: DataFrame) -> tuple[int, int]:
    """(nodes with an edge, edges).  Scores sum to the first, so their mean is the ratio of the two."""
    d = degrees(edges).agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("ends")).first()
    return d["n"], d["ends"] // 2


def score_summary(edges: DataFrame) -> DataFrame:
    """One row: edges, total, mean, least and greatest score."""
    return scored(edges).agg(F.count("*").alias("m"), F.sum("score").alias("total"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("greatest"))


def normalized(edges: DataFrame) -> DataFrame:
    """Edges with score, p = score / sum and w = score / mean, without a second pass over the scores."""
    n, m = graph_size(edges)
    return scored(edges).withColumn("p", F.col("score") / float(max(n, 1))).withColumn("w", F.col("score") * float(m) / float(max(n, 1)))
