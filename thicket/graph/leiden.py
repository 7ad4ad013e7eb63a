"""Community detection in many small graphs, each by one task, by the sequential Leiden method: modularity or CPM.

``leiden_small`` is seeded and goes through moves, refinement within communities, and aggregation.  A single graph of any size
is for ``communities.leiden_parallel``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges of a graph that one task takes.
MAX_SMALL = 5_000_000


def _moved(adjacency, size, degree, comm, total, gamma, cpm, rng, within=None):
    """Local moving until no node gains; within: a node may only join communities of its own part."""
    n = len(adjacency)
    mass = size if cpm else degree
    held: dict[int, float] = {}
    for v in range(n):
        held[comm[v]] = held.get(comm[v], 0.0) + mass[v]
    queue = list(rng.permutation(n))
    queued = [True] * n
    scale = 1.0 if cpm else 1.0 / total if total else 0.0
    at = 0
    while at < len(queue):
        v = queue[at]
        at += 1
        queued[v] = False
        own = comm[v]
        to: dict[int, float] = {own: 0.0}
        for u, w in adjacency[v]:
            if u != v and (within is None or within[u] == within[v]):
                to[comm[u]] = to.get(comm[u], 0.0) + w
        held[own] -= mass[v]
        best, gain = own, to[own] - gamma * mass[v] * held[own] * scale
        for c in sorted(to):
            g = to[c] - gamma * mass[v] * held.get(c, 0.0) * scale
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < -1e-12:
            best = max(held) + 1  # alone is better
        held[best] = held.get(best, 0.0) + mass[v]
        if best != own:
            comm[v] = best
            for u, _ in adjacency[v]:
                if comm[u] != best and not queued[u]:
                    queue.append(u)
                    queued[u] = True
    return comm


def _connected(adjacency, comm):
    """Communities split into their connected parts."""
    out, k = [-1] * len(comm), 0
    for v in range(len(comm)):
        if out[v] < 0:
            out[v], todo = k, [v]
            while todo:
                x = todo.pop()
                for u, _ in adjacency[x]:
                    if out[u] < 0 and comm[u] == comm[x]:
                        out[u] = k
                        todo.append(u)
            k += 1
    return out


def leiden(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, gamma: float = 1.0, cpm: bool = False, seed: int = 0, passes: int = 10) -> list[int]:
    """Communities of nodes 0 to n-1, numbered by their least nodes."""
    rng = np.random.default_rng(seed)
    adjacency: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        adjacency[a].append((b, w))
        if a != b:
            adjacency[b].append((a, w))
    total = 2.0 * float(weight.sum())
    size, degree = [1.0] * n, [sum(w * (2 if u == v else 1) for u, w in adjacency[v]) for v in range(n)]
    of, comm = list(range(n)), list(range(n))
    for _ in range(passes):
        comm = _connected(adjacency, _moved(adjacency, size, degree, comm, total, gamma, cpm, rng))
        if len(set(comm)) == len(comm):
            break
        parts = _connected(adjacency, _moved(adjacency, size, degree, list(range(len(comm))), total, gamma, cpm, rng, within=comm))
        if len(set(parts)) == len(parts):
            parts = comm
        k = max(parts) + 1
        above = [0] * k
        merged: list[dict[int, float]] = [{} for _ in range(k)]
        new_size, new_degree = [0.0] * k, [0.0] * k
        for v, p in enumerate(parts):
            above[p] = comm[v]
            new_size[p] += size[v]
            new_degree[p] += degree[v]
            for u, w in adjacency[v]:
                if u >= v:
                    a, b = min(p, parts[u]), max(p, parts[u])
                    merged[a][b] = merged[a].get(b, 0.0) + w
        of = [parts[x] for x in of]
        adjacency = [[] for _ in range(k)]
        for a, row in enumerate(merged):
            for b, w in row.items():
                adjacency[a].append((b, w))
                if a != b:
                    adjacency[b].append((a, w))
        size, degree, comm = new_size, new_degree, above
    found = [comm[x] for x in of]
    number: dict[int, int] = {}
    return [number.setdefault(c, len(number)) for c in found]


def leiden_small(edges: DataFrame, resolution: float = 1.0, cpm: bool = False, seed: int = 0) -> DataFrame:
    """(graph_id, id, comm) of every graph in edges(graph_id, src, dst[, weight])."""
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_SMALL:
            raise ValueError(f"{len(frame)} edges: use leiden_parallel")
        frame = frame.sort_values(["src", "dst"])
        ids, ends = np.unique(frame[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
        ends = ends.reshape(-1, 2)
        comm = leiden(ends[:, 0], ends[:, 1], frame["weight"].to_numpy(float), len(ids), resolution, cpm, seed)
        return pd.DataFrame({"graph_id": frame["graph_id"].iloc[0], "id": ids, "comm": comm})

    return weighted.select("graph_id", "src", "dst", "weight").groupBy("graph_id").applyInPandas(one, "graph_id string, id long, comm long")
