"""A graph cut in two halves with few edges between them.

The halves begin as those of the order by the second eigenvector of the normalised Laplacian.  Then the nodes of both sides that gain
most change sides, as many from either; a swap counts if the cut gets smaller, else half as many are tried, down to one pair.
Nodes are chosen by counting in ranges; nothing is gathered.  Where tasks can run side by side and hold the edges, all swaps are made
in one stage, and nodes are chosen by counts of their gains.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranked import first_k
from ..storage import qualified, shared_folder, stored
from .blocks import Blocks, Files, Part, Work, read_part, written
from .gang import Gang, shared
from .spectrum import eigenpair_of, gang_of, laid, multiplied

#: The part of a half that is swapped at first.
SHARE = 0.1


def _cut(both: DataFrame, side: DataFrame) -> tuple[DataFrame, int]:
    """(id, comm, minus) with minus the edges to the own side less those to the other one, and the edges between the sides."""
    a, b = side.select(F.col("id").alias("src"), F.col("comm").alias("a")), side.select(F.col("id").alias("dst"), F.col("comm").alias("b"))
    ends = both.join(a, "src").join(b, "dst")
    told = stored(ends.groupBy(F.col("src").alias("id"), F.col("a").alias("comm")).agg(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(-1)).alias("minus"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("out")), "gains")
    return told.select("id", "comm", "minus"), (told.agg(F.sum("out")).first()[0] or 0) // 2


def _chosen(gang: Gang, minus: dict[int, np.ndarray], side: dict[int, np.ndarray], k: int) -> dict[int, np.ndarray]:
    """The nodes of each part that are among the first k of either side by minus and id; parts are runs of ids."""
    ways = (1.0, -1.0)
    own = [(n, [np.unique(m[side[n] == way], return_counts=True) for way in ways]) for n, m in minus.items()]
    told = sorted((row for rows in gang.all_told(own) for row in rows), key=lambda row: row[0])
    out: dict[int, list] = {n: [] for n in minus}
    for i, way in enumerate(ways):
        values, at = np.unique(np.concatenate([counts[i][0] for _, counts in told]), return_inverse=True)
        many = np.cumsum(np.bincount(at, np.concatenate([counts[i][1] for _, counts in told])))
        last = min(int(np.searchsorted(many, k)), len(values) - 1)
        left = k - int(many[last - 1] if last else 0)
        for n, counts in told:
            found, count = counts[i]
            equal = min(left, int(count[found == values[last]].sum()))
            if n in out:
                mine = np.flatnonzero(side[n] == way)
                gains = minus[n][mine]
                out[n] += [mine[gains < values[last]], mine[gains == values[last]][:equal]]
            left -= equal
    return {n: np.concatenate(rows) for n, rows in out.items()}


def _side_by_side(batches: Iterable[pa.RecordBatch], files: Files, count: int, folder: str, sides: str, k: int) -> Iterator[pa.RecordBatch]:
    """(id, comm) after all swaps, by tasks that each hold some parts."""
    for _ in batches:
        pass
    gang, work = Gang(folder), Work()
    parts = {n: part for n in shared(range(count), gang) if (part := Part(files, n)).n}

    def gains(side: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], int]:
        """Edges to the own side less those to the other one, and four times the cut."""
        y = multiplied(gang, parts, work, {n: s[:, None] for n, s in side.items()})
        minus = {n: np.rint(s * y[n][:, 0]).astype(np.int64) for n, s in side.items()}
        return minus, sum(gang.all_told(sum(int(parts[n].columns["d"].sum()) - int(m.sum()) for n, m in minus.items())))

    side = {n: 1.0 - 2.0 * read_part(sides, "part", n, ["comm"]).column(0).to_numpy() for n in parts}
    minus, cut = gains(side)
    while k:
        tried = {n: s.copy() for n, s in side.items()}
        for n, some in _chosen(gang, minus, side, k).items():
            tried[n][some] *= -1
        after, less = gains(tried)
        if less < cut:
            side, minus, cut = tried, after, less
        else:
            k //= 2
    for n, part in parts.items():
        yield pa.RecordBatch.from_arrays([pa.array(part.columns["id"]), pa.array((side[n] < 0).astype(np.int64))], names=["id", "comm"])


def _swapped(graph: Blocks, side: DataFrame, k: int, tasks: int) -> DataFrame:
    placed = graph.nodes.select("id", "part", "at").join(side, "id").select("part", "at", "comm")
    sides, _ = written(placed.repartitionById(graph.parts, "part").sortWithinPartitions("part", "at"), "part", "sides")
    work = partial(_side_by_side, files=graph.files, count=graph.parts, folder=qualified(graph.spark, shared_folder(graph.spark)), sides=sides, k=k)
    return stored(graph.spark.range(0, tasks, 1, tasks).mapInArrow(work, "id long, comm long", barrier=True), "halves")


def bisection(edges: DataFrame, tolerance: float = 1e-4, seed: int = 42) -> DataFrame:
    """(id, comm): comm 0 holds half of the nodes of edges(src, dst), rounded down, comm 1 the others.  Swaps end when the best pair no
    longer makes the cut smaller.  ValueError without edges; a single edge is cut."""
    edges = stored(edges.select("src", "dst"), "edges")
    graph = laid(edges, seed)
    _, _, vector = eigenpair_of(graph, tolerance)
    # equal up to rounding counts as equal, so that the order is the same on every run
    order = stored(vector.select("id", F.round(F.col("x") / F.sqrt("d"), 9).alias("x")), "order")
    n = order.count()
    low = first_k(order, ["x", "id"], n // 2).select("id").withColumn("low", F.lit(True))
    side = stored(order.join(low, "id", "left").select("id", F.when(F.col("low"), 0).otherwise(1).cast("long").alias("comm")), "side")
    k = max(1, int(SHARE * n / 2))
    if tasks := gang_of(graph):
        return _swapped(graph, side, k, tasks)
    both = stored(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    now, cut = _cut(both, side)
    while k:
        swapped = None
        for c in (0, 1):
            some = first_k(now.filter(F.col("comm") == c).select("minus", "id"), ["minus", "id"], k).select("id")
            swapped = some if swapped is None else swapped.unionByName(some)
        tried = stored(now.select("id", "comm").join(swapped.withColumn("swap", F.lit(1).cast("long")), "id", "left").select("id", F.col("comm").bitwiseXOR(F.coalesce("swap", F.lit(0).cast("long"))).alias("comm")), "tried")
        after, less = _cut(both, tried)
        if less < cut:
            now, cut = after, less
        else:
            k //= 2
    return now.select("id", "comm")
