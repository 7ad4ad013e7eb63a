"""Edge sparsifiers: weighted, Bernoulli, top-k and uniform samplers; the spectral one is in graph.resistance."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_total
from ..functions.ranked import first_k
from ..functions.rng import hash_integer, hash_uniform
from ..storage import once, stored
from .degrees import graph_size, scored
from .edges import symmetric

SCALE = 1_000_000_000


def budget(alpha: float, m: int) -> int:
    """ceil(alpha m) in doubles; ValueError unless 0 < alpha <= 1."""
    if not 0 < alpha <= 1:
        raise ValueError(f"retention must be in (0, 1], not {alpha}")
    return math.ceil(float(alpha) * m)


def _edge_columns(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", F.lit(1.0).alias("weight"))


def _bernoulli(edges: DataFrame, p: Column, seed: int) -> DataFrame:
    return edges.filter(hash_uniform(seed, "src", "dst") < F.least(F.lit(1.0), p))


def _kept_once(edges: DataFrame) -> DataFrame:
    """Edges that are cheap to read again, with their scores if they have them."""
    return once(edges if "score" in edges.columns else edges.select("src", "dst"), "edges")


def bernoulli(edges: DataFrame, alpha: float, seed: int = 42) -> DataFrame:
    """Each edge by itself with probability min(1, score / sum * ceil(alpha m)); clipping makes the expected count at most
    the budget."""
    edges = _kept_once(edges)
    n, m = graph_size(edges)
    q = budget(alpha, m)
    return _edge_columns(_bernoulli(scored(edges), F.col("score") / float(max(n, 1)) * float(q), seed))


def bernoulli_by_mean(edges: DataFrame, alpha: float, seed: int = 42) -> DataFrame:
    """Each edge with probability min(1, alpha * score / mean)."""
    edges = _kept_once(edges)
    n, m = graph_size(edges)
    budget(alpha, m)
    return _edge_columns(_bernoulli(scored(edges), F.lit(float(alpha)) * F.col("score") / (float(n) / max(m, 1)), seed))


def degree_sum(edges: DataFrame, alpha: float, seed: int = 42) -> DataFrame:
    """Each edge with probability min(1, (d_src + d_dst) / sum * ceil(alpha m)): hubs are favoured."""
    from .degrees import degrees

    edges = _kept_once(edges)
    total = degrees(edges).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 1
    _, m = graph_size(edges)
    q = budget(alpha, m)
    return _edge_columns(_bernoulli(scored(edges), F.col("d_sum") / float(total) * float(q), seed))


def top_k(edges: DataFrame, alpha: float) -> DataFrame:
    """The ceil(alpha m) edges of the highest scores; of equal scores the least (src, dst)."""
    edges = _kept_once(edges)
    _, m = graph_size(edges)
    q = budget(alpha, m)
    ordered = stored(scored(edges).select("src", "dst", (-F.col("score")).alias("minus")), "ordered")
    return _edge_columns(first_k(ordered, ["minus", "src", "dst"], q))


def uniform(edges: DataFrame, alpha: float, seed: int = 42) -> DataFrame:
    """Exactly ceil(alpha m) edges, each set as likely."""
    edges = _kept_once(edges)
    return uniform_count(edges, budget(alpha, edges.count()), seed)


def uniform_count(edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Exactly k edges, or all."""
    ordered = stored(edges.select("src", "dst", hash_integer(seed, "src", "dst").alias("h")), "ordered")
    return _edge_columns(first_k(ordered, ["h", "src", "dst"], k))


def random_sparsify(edges: DataFrame, directed_edges: int, seed: int = 42) -> tuple[DataFrame, float]:
    """(both directions of directed_edges // 2 edges drawn uniformly, seconds that drawing and storing them took)."""
    began = time.perf_counter()
    kept = stored(symmetric(uniform_count(edges, directed_edges // 2, seed).select("src", "dst")), "random")
    return kept, time.perf_counter() - began


def with_replacement(edges: DataFrame, alpha: float, seed: int = 42) -> DataFrame:
    """q = ceil(alpha m) draws with probability p = score / sum; edges drawn with their draws k and weight k / (q p).

    Scores become whole numbers, so that their running total in the order of (src, dst) is exact.  A draw is a hash of its
    number; draws meet intervals of the running total through equal slices of it, not by comparing all with all.
    """
    edges = _kept_once(edges)
    n, m = graph_size(edges)
    q = budget(alpha, m)
    whole = scored(edges).select("src", "dst", "score", F.floor(F.col("score") * SCALE).alias("w"))
    spans = stored(running_total(whole, "w", ["src", "dst"], "low").withColumn("high", F.col("low") + F.col("w")), "spans")
    total = spans.agg(F.max("high")).first()[0] or 1
    slice_ = max(1, total // max(1, m))
    cut = spans.filter("w > 0").withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") / F.lit(slice_)), F.floor((F.col("high") - 1) / F.lit(slice_)))))
    draws = edges.sparkSession.range(q).select(F.pmod(hash_integer(seed, "id"), F.lit(total)).alias("r")).withColumn("slice", F.floor(F.col("r") / F.lit(slice_)))
    hit = draws.join(cut, "slice").filter("r >= low AND r < high")
    counted = hit.groupBy("src", "dst").agg(F.count("*").alias("k"), F.first("score").alias("score"))
    return counted.select("src", "dst", "k", (F.col("k") / (F.lit(float(q)) * (F.col("score") / float(max(n, 1))))).alias("weight"))


METHODS: dict[str, Callable[..., DataFrame]] = {"paper": with_replacement, "probabilistic_no_replace": bernoulli, "deterministic": lambda edges, alpha, seed=42: top_k(edges, alpha), "uniform_random": uniform, "degree_sampling": degree_sum, "bernoulli_by_mean": bernoulli_by_mean}

# The strength of resparsification that stands for a retention in the spectral method; 1 keeps the graph.
EPSILON = {0.2: 3.0, 0.4: 1.5, 0.6: 0.8, 0.8: 0.3, 1.0: 0.0}


def epsilon_of(alpha: float) -> float:
    """EPSILON between its entries by a straight line; ValueError unless 0 < alpha <= 1."""
    budget(alpha, 1)
    known = sorted(EPSILON)
    low = max([a for a in known if a <= alpha], default=known[0])
    high = min([a for a in known if a >= alpha], default=known[-1])
    share = (alpha - low) / (high - low) if high > low else 0.0
    return EPSILON[low] + share * (EPSILON[high] - EPSILON[low])


def sparsify(edges: DataFrame, method: str, alpha: float, seed: int = 42) -> DataFrame:
    """By a method's name; alpha 1 gives the graph itself but for sampling with replacement.  ValueError for other names and
    retentions outside (0, 1]."""
    if method != "spectral" and method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    budget(alpha, 1)
    if alpha == 1 and method != "paper":
        return edges.select("src", "dst", F.lit(1.0).alias("weight"))
    if method == "spectral":
        from ..graph.resistance import spectral

        return spectral(edges, epsilon_of(alpha), seed)
    return METHODS[method](edges, alpha, seed)


def survival_curve(edges: DataFrame, bridge: DataFrame, alphas: list[float], seeds: list[int]) -> DataFrame:
    """Per alpha: mean keep-probability of bridge and other edges, their ratio, and the share of seeds and bridge edges that a
    Bernoulli draw removes."""
    n, m = graph_size(edges)
    spark = edges.sparkSession
    marked = scored(edges).join(bridge.select("src", "dst", F.lit(True).alias("bridge")), ["src", "dst"], "left").withColumn("bridge", F.coalesce("bridge", F.lit(False)))
    grid = spark.createDataFrame([(float(a), s) for a in alphas for s in seeds], "alpha double, seed long")
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", "src", "dst", "seed")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    p = F.least(F.lit(1.0), F.col("alpha") * F.col("score") / (float(n) / max(m, 1)))
    rows = marked.join(F.broadcast(grid)).withColumn("p", p).withColumn("gone", (u >= F.col("p")).cast("double"))
    out = rows.groupBy("alpha").agg(F.avg(F.when(F.col("bridge"), F.col("p"))).alias("p_bridge"), F.avg(F.when(~F.col("bridge"), F.col("p"))).alias("p_other"), F.avg(F.when(F.col("bridge"), F.col("gone"))).alias("bridge_removed"))
    return out.withColumn("ratio", F.try_divide("p_bridge", "p_other"))
