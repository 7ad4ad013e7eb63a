"""LFR benchmark graphs on DataFrames: degrees and community sizes by power laws, exact degrees, a given share of mixed edges.

1. Sizes are drawn until they add up to n; degrees are drawn for all nodes; a node's inner degree is its degree's share within its
   community, rounded up or down at random so that the mixing is right on average.
2. Nodes bid for places in communities that are larger than their inner degree.  In a round each node without a place bids for one of
   the free places it fits in, any as likely; of several bids for a place the largest inner degree wins.  The few that are left take
   the free places in order of size and inner degree.
3. A community, whose size is bounded, is one group: its inner degrees are realised by a simple graph, node by node from the largest
   degree down, which random switches of edges then mix.  Stubs for which there is no partner become outer ones.
4. Outer stubs are paired in a hashed order.  Loops, repeated edges and edges within a community are removed by switching: such an edge
   and a random other one exchange ends, if that gives two edges that are right.  All of them switch side by side, each with a
   partner of its own.  Degrees never change.

If switching doesn't end, all begins anew with another seed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import numbered, running_total
from ..functions.rng import hash_integer, hash_uniform
from ..storage import stored

#: Rounds of bids and of switching, attempts, and switches an edge that mix a community.
BIDS, SWITCHES, ATTEMPTS, MIXED = 4, 60, 20, 10


def _power(u: Column, low: float, high: float, exponent: float) -> Column:
    """The quantile of a power law between low and high."""
    if abs(exponent - 1) < 1e-9:
        return F.lit(low) * F.pow(F.lit(high / low), u)
    a, b = low ** (1 - exponent), high ** (1 - exponent)
    return F.pow(F.lit(a) + u * (b - a), F.lit(1 / (1 - exponent)))


def _lowest(average: float, most: float, exponent: float) -> float:
    """Where a power law up to most must begin to have this mean."""

    def mean(low: float) -> float:
        steps = 4000
        total = weight = 0.0
        for i in range(steps):  # by the substitution x = low * (most / low) ** t
            x = low * (most / low) ** ((i + 0.5) / steps)
            total, weight = total + x ** (2 - exponent), weight + x ** (1 - exponent)
        return total / weight

    low, high = 1.0, float(most) - 1e-6
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < average else (low, mid)
    return low


def community_sizes(spark: SparkSession, n: int, least: int, most: int, exponent: float, seed: int) -> DataFrame:
    """(comm, size) from least to most that add up to n.  The last community takes what is left if that is enough; else what is left is
    dealt to the others, the smallest first."""
    drawn = spark.range(-(-n // least)).select(F.col("id").alias("comm"), F.least(F.lit(most), F.floor(_power(hash_uniform(seed, "id"), float(least), most + 1.0, exponent))).cast("long").alias("size"))
    spans = stored(running_total(drawn, "size", ["comm"], "low").filter(F.col("low") < n), "sizes")
    last = spans.agg(F.max(F.struct("low", "comm", "size"))).first()[0]
    rest = min(n - last["low"], last["size"])
    if rest >= least or last["low"] == 0:
        return spans.select("comm", F.when(F.col("comm") == last["comm"], rest).otherwise(F.col("size")).alias("size"))
    others = numbered(spans.filter(F.col("comm") != last["comm"]).select("comm", "size"), ["size", "comm"], "rank")
    k = last["comm"]  # communities before the last one
    return others.select("comm", (F.col("size") + rest // k + (F.col("rank") < rest % k).cast("long")).alias("size"))


def _placed(nodes: DataFrame, sizes: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, d, inner, comm): nodes(id, d, inner) in communities of more members than their inner degree; where the last nodes don't
    fit, their inner degree is lowered."""
    ordered = stored(running_total(sizes.withColumn("minus", -F.col("size")), "size", ["minus", "comm"], "low"), "ordered")
    free = stored(ordered.select("comm", "size", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("size") - 1)).alias("slot")), "free")
    waiting, settled = stored(nodes, "waiting"), None
    for k in range(BIDS):
        # a number for each size there is: how many free places are in larger communities, which come first
        room, total = {}, 0
        for r in free.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
            total += r["n"]
            room[r["size"]] = total
        fits = waiting.sparkSession.createDataFrame([(i, next((c for s, c in sorted(room.items()) if s > i), 0)) for i in range(max(room) + 1)], "inner long, room long")
        bids = waiting.join(F.broadcast(fits), "inner").filter("room > 0").withColumn("at", F.pmod(hash_integer(seed + 10 + k, "id"), F.col("room")))
        won = bids.groupBy("at").agg(F.max(F.struct("inner", hash_integer(seed + 30 + k, "id").alias("h"), "id", "d")).alias("x"))
        got = stored(numbered(free.withColumn("minus", -F.col("size")), ["minus", "slot"], "at").join(won, "at").select("x.id", "x.d", "x.inner", "comm", "size", "slot"), "won")
        settled = got if settled is None else settled.unionByName(got)
        waiting = stored(waiting.join(got.select("id"), "id", "left_anti"), "waiting")
        free = stored(free.join(got.select("slot"), "slot", "left_anti"), "free")
    left = numbered(waiting.withColumn("minus", -F.col("inner")), ["minus", "id"], "at").join(numbered(free.withColumn("m", -F.col("size")), ["m", "slot"], "at").select("at", "comm", "size"), "at")
    every = settled.select("id", "d", "inner", "comm", "size").unionByName(left.select("id", "d", "inner", "comm", "size"))
    return every.select("id", "d", F.least("inner", F.col("size") - 1).alias("inner"), "comm")


def _realised(degrees: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(edges, left): a random simple graph of these degrees as pairs of places, and the stubs of each place that found no partner."""
    n, rest, left = len(degrees), degrees.copy(), np.zeros(len(degrees), np.int64)
    there = np.zeros((n, n), bool)
    while rest.any():
        at = int(np.argmax(rest))
        order = np.lexsort((rng.random(n), -rest))
        to = order[(order != at) & (rest[order] > 0)][: rest[at]]
        there[at, to] = there[to, at] = True
        left[at] += rest[at] - len(to)
        rest[to] -= 1
        rest[at] = 0
    edges = np.argwhere(np.triu(there))
    for i, j, turn in zip(*(rng.integers(0, max(1, len(edges)), MIXED * len(edges)) for _ in range(2)), rng.random(MIXED * len(edges)) < 0.5, strict=True):
        (a, b), (x, y) = edges[i], edges[j][::-1] if turn else edges[j]
        if a != x and b != y and a != y and b != x and not there[a, x] and not there[b, y]:
            there[a, b] = there[b, a] = there[x, y] = there[y, x] = False
            there[a, x] = there[x, a] = there[b, y] = there[y, b] = True
            edges[i], edges[j] = (a, x), (b, y)
    return edges, left


def _inside(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        """Edges (a, b) of a community, and (a, null, stubs that are left)."""
        frame = frame.sort_values("id")
        ids, comm = frame["id"].to_numpy(), int(frame["comm"].iloc[0])
        edges, left = _realised(frame["inner"].to_numpy(np.int64), np.random.default_rng((seed, comm)))
        some = np.flatnonzero(left)
        rows = {"a": np.r_[ids[edges[:, 0]], ids[some]], "b": pd.array([*ids[edges[:, 1]].tolist(), *[None] * len(some)], "Int64"), "left": np.r_[np.zeros(len(edges), np.int64), left[some]]}
        return pd.DataFrame(rows)

    return one


def _switched(edges: DataFrame, n: int, seed: int) -> DataFrame | None:
    """(src, dst) of the n edges(eid, a, ca, b, cb) after switching, or None if some are still wrong.  ca and cb are the ends' communities,
    which must differ; eid goes from 0 to n - 1."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
    for k in range(SWITCHES):
        twice = F.row_number().over(Window.partitionBy("pair").orderBy("eid")) > 1
        marked = stored(edges.withColumn("pair", pair("a", "b")).withColumn("wrong", twice | (F.col("ca") == F.col("cb"))), "marked")
        if not marked.filter("wrong").limit(1).count():
            return marked.select(F.col("pair.src").alias("src"), F.col("pair.dst").alias("dst"))
        draw = F.pmod(hash_integer(seed + k, F.lit("partner"), "eid"), F.lit(n))
        wrong = marked.filter("wrong").select("eid", "a", "ca", "b", "cb", draw.alias("other"))
        # one switch for each partner
        asked = wrong.groupBy("other").agg(F.min_by(F.struct("eid", "a", "ca", "b", "cb"), hash_integer(seed + k, F.lit("first"), "eid")).alias("x")).select("x.*", "other")
        partner = marked.filter("NOT wrong").select(F.col("eid").alias("other"), F.col("a").alias("x"), F.col("ca").alias("cx"), F.col("b").alias("y"), F.col("cb").alias("cy"))
        turned = hash_uniform(seed + k, F.lit("turn"), "eid") < 0.5
        both = asked.join(partner, "other").withColumns({c: F.when(turned, F.col(d)).otherwise(F.col(c)) for c, d in (("x", "y"), ("cx", "cy"), ("y", "x"), ("cy", "cx"))})
        both = both.filter("ca <> cx AND cb <> cy").withColumns({"p": pair("a", "x"), "q": pair("b", "y")}).filter("p <> q")
        new = both.select("eid", F.explode(F.array("p", "q")).alias("pair")).withColumn("times", F.count("*").over(Window.partitionBy("pair")))
        new = new.join(marked.select("pair").withColumn("there", F.lit(1)), "pair", "left")
        fine = new.groupBy("eid").agg(F.max("times").alias("times"), F.count("there").alias("there")).filter("times = 1 AND there = 0")
        done = stored(both.join(fine.select("eid"), "eid"), "done")
        mine = done.select("eid", F.struct("a", "ca", F.col("x").alias("b"), F.col("cx").alias("cb")).alias("new"))
        theirs = done.select(F.col("other").alias("eid"), F.struct(F.col("b").alias("a"), F.col("cb").alias("ca"), F.col("y").alias("b"), F.col("cy").alias("cb")).alias("new"))
        after = marked.join(mine.unionByName(theirs), "eid", "left")
        edges = after.select("eid", *(F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) for c in ("a", "ca", "b", "cb")))
    return None


def drawn_degrees(spark: SparkSession, n: int, average: float, most: int, exponent: float, seed: int) -> DataFrame:
    """(id, d) of nodes 0 to n - 1: degrees from 1 to most by a power law with about this mean, with an even sum."""
    degree = F.greatest(F.lit(1), F.least(F.lit(most), F.round(_power(hash_uniform(seed, "id"), _lowest(average, most, exponent), float(most), exponent)))).cast("long")
    nodes = stored(spark.range(n).withColumn("d", degree), "degrees")
    odd = (nodes.agg(F.sum("d")).first()[0] or 0) % 2
    return nodes.withColumn("d", F.col("d") + F.when((F.col("id") == 0) & F.lit(bool(odd)), F.when(F.col("d") < most, 1).otherwise(-1)).otherwise(0))


def lfr(spark: SparkSession, n: int, mu: float, average: float = 15, most: int = 50, degree_exponent: float = 3.0, size_exponent: float = 1.5, least_size: int = 20, most_size: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of nodes 0 to n - 1: simple edges(src, dst), labels(id, comm).

    A node's degree is exactly the one drawn (between 1 and most; one node's differs by 1 if the sum was odd).  Sizes are bounded as in
    ``community_sizes``, with most_size n // 5 at most and least_size 10 at least.  The share of edges between communities is mu up to
    random rounding and what doesn't fit into small communities.  RuntimeError if no attempt gives a simple graph, ValueError unless
    0 <= mu <= 1, or if there is but one community and mu is not 0.
    """
    if not 0 <= mu <= 1:
        raise ValueError(f"mu must be in [0, 1], not {mu}")
    most_size = max(10, min(most_size, n // 5))
    least_size = max(10, min(least_size, most_size - 5))
    most_size, most = max(most_size, least_size), min(most, n - 1)
    for attempt in range(ATTEMPTS):
        s = seed + 1000 * attempt
        sizes = stored(community_sizes(spark, n, least_size, most_size, size_exponent, s), "sizes")
        largest = sizes.agg(F.max("size")).first()[0]
        nodes = drawn_degrees(spark, n, average, most, degree_exponent, s + 1)
        inner = F.least(F.floor((1 - mu) * F.col("d") + hash_uniform(s + 2, "id")), F.col("d"), F.lit(largest - 1)).cast("long")
        placed = stored(_placed(nodes.withColumn("inner", inner), sizes, n, s), "placed")
        inside = stored(placed.groupBy("comm").applyInPandas(_inside(s + 3), "a long, b long, left long"), "inside")
        left = inside.filter("b IS NULL").select(F.col("a").alias("id"), "left")
        outer = placed.join(left, "id", "left").select("id", "comm", (F.col("d") - F.col("inner") + F.coalesce("left", F.lit(0))).alias("outer")).filter("outer > 0")
        stubs = outer.select("id", "comm", F.explode(F.sequence(F.lit(1).cast("long"), "outer")).alias("k")).withColumn("h", hash_integer(s + 4, "id", "k"))
        at = numbered(stubs, ["h", "id", "k"], "at")
        even, odd = at.filter("at % 2 = 0"), at.filter("at % 2 = 1")
        side = lambda half, x: half.select((F.floor(F.col("at") / 2)).cast("long").alias("eid"), F.col("id").alias(x), F.col("comm").alias(f"c{x}"))
        mixed = stored(side(even, "a").join(side(odd, "b"), "eid"), "mixed")
        n_mixed = mixed.count()
        if n_mixed and sizes.count() == 1:
            raise ValueError("one community has no outer edges: lower mu or take more nodes")
        found = _switched(mixed, n_mixed, s + 5)
        if found is not None:
            own = inside.filter("b IS NOT NULL").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            return stored(own.unionByName(found), "lfr"), placed.select("id", "comm")
    raise RuntimeError(f"no simple graph in {ATTEMPTS} attempts")
