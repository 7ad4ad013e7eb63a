"""Connected components by alternating large-star and small-star steps.

Each round rewires edges towards the least neighbour, keeps connectivity and ends in stars around the least id of each
component after O(log^2 n) rounds, usually three to five.  Rounds join the pre-aggregated least neighbours; a hub's
edges are dealt to many tasks and never collected into one row or group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranked import keyed_join
from ..storage import stored

MAX_ROUNDS = 64


def _large_star(edges: DataFrame, m: int) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"), F.count("*").alias("count"))
    return keyed_join(both.filter("dst > src"), least, "src", 2 * m, ["dst"]).select(F.col("low").alias("src"), "dst").filter("src <> dst")


def _small_star(edges: DataFrame, m: int) -> DataFrame:
    """edges have src < dst; each dst moves its smaller neighbours to the least of them."""
    least = edges.groupBy("dst").agg(F.min("src").alias("low"), F.count("*").alias("count"))
    moved = keyed_join(edges, least, "dst", m, ["src"]).select(F.col("low").alias("src"), F.col("src").alias("dst")).filter("src <> dst")
    return moved.unionByName(least.select(F.col("low").alias("src"), "dst")).distinct()


def near_labels(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, component): the least id within ``rounds`` + 1 steps of each node of edges(src, dst).  Nodes of one label are
    connected, though a component may have several labels; much cheaper than component_labels."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component"))
    for _ in range(rounds):
        # a node's own label takes part, as each neighbour's label is at most the node itself
        labels = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("component"))
    return labels


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge in edges(src, dst); component is the least id it reaches.

    Self-loops keep their node; null ends are ignored; direction and repeats don't matter.
    """
    clean = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    ids = clean.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    now = stored(clean.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        now = stored(_small_star(_large_star(now, sign[0]), sign[0]), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    return ids.join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def graph_counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: n, m, components, connected; with nodes(id), isolated ones count."""
    parts = component_labels(edges).select("component").distinct().agg(F.count("*").alias("c"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = (nodes.select("id").distinct().join(ends, "id", "left_anti") if nodes is not None else ends.filter(F.lit(False))).agg(F.count("*").alias("a"))
    one = ends.agg(F.count("*").alias("n0")).crossJoin(alone).crossJoin(parts).crossJoin(edges.agg(F.count("*").alias("m")))  # of one row each
    return one.select((F.col("n0") + F.col("a")).alias("n"), "m", (F.col("c") + F.col("a")).alias("components"), (F.col("c") + F.col("a") <= 1).alias("connected"))
