"""Effective resistance and spectral sparsification."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hash_integer, hash_uniform
from ..storage import once, removed
from .blocks import CHUNK, Block, Blocks, Part, Work, added, packed, vectors, written

#: Nodes of a graph whose Laplacian one task inverts.
MAX_DENSE = 3000


def laplacian(src: np.ndarray, dst: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros((n, n))
    w = np.ones(len(src)) if weight is None else weight
    np.add.at(out, (src, dst), -w)
    np.add.at(out, (dst, src), -w)
    out[np.arange(n), np.arange(n)] = -out.sum(1)
    return out


def exact(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, resistance) of every edge of every graph in edges(graph_id, src, dst), by pseudo-inverse."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(frame[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
        if len(ids) > MAX_DENSE:
            raise ValueError(f"{len(ids)} nodes: use sketched")
        a, b = ends.reshape(-1, 2).T
        p = np.linalg.pinv(laplacian(a, b, len(ids)), hermitian=True)
        return pd.DataFrame({"graph_id": frame["graph_id"].iloc[0], "src": frame["src"], "dst": frame["dst"], "resistance": p[a, a] + p[b, b] - 2 * p[a, b]})

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(one, "graph_id string, src long, dst long, resistance double")


def fiedler(edges: DataFrame) -> DataFrame:
    """(graph_id, lambda2): second smallest eigenvalue of the normalised Laplacian."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(frame[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
        if len(ids) > MAX_DENSE:
            raise ValueError(f"{len(ids)} nodes: too many for a dense Laplacian")
        a, b = ends.reshape(-1, 2).T
        lap = laplacian(a, b, len(ids))
        root = 1 / np.sqrt(np.diag(lap))
        return pd.DataFrame({"graph_id": [frame["graph_id"].iloc[0]], "lambda2": [float(np.linalg.eigvalsh(root[:, None] * lap * root[None, :])[1])]})

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(one, "graph_id string, lambda2 double")


def _signs(rows: pa.Table, low: int, high: int, columns: int) -> np.ndarray:
    """A sign for each column, of some rows of a block's edges, as the edge's end in the home sees it."""
    some = rows.slice(low, high - low)
    words = [some.column(f"s{w}").to_numpy() for w in range(-(-columns // 32))]
    out = np.column_stack([np.where(words[k // 32] >> (k % 32) & 1, 1.0, -1.0) for k in range(columns)])
    return np.where(some.column("first").to_numpy(), 1.0, -1.0)[:, None] * out


@dataclass
class _Ends(Work):
    """The right-hand sides: the edges' signs, summed at either end with opposite directions."""

    columns: int
    values = False

    def __post_init__(self):
        self.k = self.columns

    def make(self, part: Part) -> None:
        return None

    def _sum(self, block: Block, to: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.columns))
        for low in range(0, len(to), CHUNK):
            # the nodes that the piece touches, in order
            mine, at = np.unique(to[low : low + CHUNK], return_inverse=True)
            out[mine] += added(at, np.arange(len(at)), _signs(block.rows, low, low + len(at), self.columns), len(mine))
        return out

    def out(self, part: Part, block: Block, x: None) -> np.ndarray:
        return -self._sum(block, block.b, len(block.touched))

    def local(self, part: Part, x: None) -> np.ndarray:
        y = np.zeros((part.n, self.columns))
        for block in part.blocks.values():
            y += self._sum(block, block.a, part.n)
            if block.other == part.number:
                y[block.touched] -= self._sum(block, block.b, len(block.touched))
        return y

    def done(self, part: Part, x: None, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = y / math.sqrt(self.columns)
        yield packed(part, (r * r / part.columns["d"][:, None]).sum(0), r=r)


@dataclass
class _Round(Work):
    """A round of conjugate gradients.  The solution x so far, the direction p and its product q are all that is written; the residual
    follows from the last two directions, so that it need not be."""

    columns: int
    start: str
    last: str | None = None
    before: str | None = None
    alpha: np.ndarray | float = 0.0
    beta: np.ndarray | float = 0.0
    beta_before: np.ndarray | float = 0.0

    def __post_init__(self):
        self.k = self.columns

    def make(self, part: Part) -> np.ndarray:
        d = part.columns["d"][:, None]
        if self.last is None:
            r = vectors(part, self.start, "r")
            p = r / d
        else:
            p = vectors(part, self.last, "p")
            part.solution = _solution(part, self.last, self.alpha)
            r = d * (p if self.before is None else p - self.beta_before * vectors(part, self.before, "p")) - self.alpha * vectors(part, self.last, "q")
            p = r / d + self.beta * p
        part.note = r
        return p

    def done(self, part: Part, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        d, r = part.columns["d"][:, None], part.note
        q = d * x - y
        yield packed(part, np.r_[(r * r / d).sum(0), (x * q).sum(0), (r * q / d).sum(0), (q * q / d).sum(0)], p=x, q=q, x=np.zeros_like(x) if self.last is None else part.solution)


def _solution(part: Part, folder: str, alpha: np.ndarray | float) -> np.ndarray:
    """The solution after the round that wrote the folder."""
    return vectors(part, folder, "x") + alpha * vectors(part, folder, "p")


@dataclass
class _Distances(Work):
    """Squared distances of the edges' ends in the solutions; ids go along with the values, bit by bit."""

    columns: int
    last: str | None
    alpha: np.ndarray | float

    def __post_init__(self):
        self.k = self.columns + 1

    def make(self, part: Part) -> np.ndarray:
        x = np.zeros((part.n, self.columns)) if self.last is None else _solution(part, self.last, self.alpha)
        return np.column_stack([part.columns["id"].view(np.float64), x])

    def out(self, part: Part, block: Block, x: np.ndarray) -> None:
        return None

    def local(self, part: Part, x: np.ndarray) -> np.ndarray:
        return np.zeros((0, self.k))

    def taken(self, part: Part, block: Block, got: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(block.a), CHUNK):
            one, two = x[block.a[low : low + CHUNK]], got[block.b[low : low + CHUNK]]
            ids = [np.ascontiguousarray(v[:, 0]).view(np.int64) for v in (one, two)]
            first = block.rows.slice(low, CHUNK).column("first").to_numpy()
            distance = ((one[:, 1:] - two[:, 1:]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.where(first, *ids), np.where(first, *ids[::-1]), distance)], names=["src", "dst", "resistance"])

    def done(self, part: Part, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = part.blocks.get(part.number)
        if own is not None:
            yield from self.taken(part, own, x[own.touched], y, x)


def sketched(edges: DataFrame, columns: int = 48, seed: int = 42, rounds: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """(src, dst, resistance), estimated for a graph of any size.

    Random signs on the edges give ``columns`` right-hand sides; conjugate gradients with a diagonal preconditioner solve
    the Laplacian for all of them at once, one product of the matrix in blocks a round; the squared distance of an edge's ends in
    the solutions estimates its resistance, with a relative error of about sqrt(2 / columns).
    """
    words = {f"s{w}": hash_integer(seed + w, F.least("src", "dst"), F.greatest("src", "dst")).bitwiseAND(F.lit((1 << 32) - 1)) for w in range(-(-columns // 32))}
    graph = Blocks(once(edges.select("src", "dst"), "edges"), of_edges=words)
    total = lambda rows: np.sum([r["sums"] for r in rows.select("sums").collect()] or [np.zeros(4 * columns)], axis=0)  # noqa: E731  # a row a part
    start, rows = written(graph.step(_Ends(columns), "part int, r binary, sums array<double>"), "part", "start")
    first = now = total(rows)[:columns]
    work = _Round(columns, start)
    for _ in range(rounds):
        if (now <= tolerance**2 * first).all():
            break
        folder, rows = written(graph.step(work, "part int, p binary, q binary, x binary, sums array<double>"), "part", "cg")
        now, pq, rq, qq = total(rows).reshape(4, -1)
        alpha = np.divide(now, pq, out=np.zeros(columns), where=pq != 0)
        if used := work.before or (start if work.last else None):  # so two rounds' files are there at most beside the one that is written
            removed(graph.spark, used)
        rho = np.maximum(0.0, now - 2 * alpha * rq + alpha * alpha * qq)
        beta = np.divide(rho, now, out=np.zeros(columns), where=now != 0)
        work, now = _Round(columns, start, folder, work.last, alpha, beta, work.beta), rho
    else:
        warnings.warn(f"the resistances have not settled in {rounds} rounds", stacklevel=2)
    return graph.step(_Distances(columns, work.last, work.alpha), "src long, dst long, resistance double")


def spectral(edges: DataFrame, epsilon: float, seed: int = 42, columns: int = 48, dense: bool = False) -> DataFrame:
    """Each edge with probability min(1, 4 R ln n / epsilon^2); weight 1 / p.  dense: resistances are exact, of MAX_DENSE nodes
    at most; else they are sketched."""
    edges = once(edges.select("src", "dst"), "edges")
    n = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count()
    own = exact(edges.select(F.lit("g").alias("graph_id"), "src", "dst")).drop("graph_id") if dense else sketched(edges, columns, seed)
    p = F.least(F.lit(1.0), F.col("resistance") * (4.0 * math.log(max(n, 2)) / epsilon**2))
    return own.withColumn("p", p).filter(hash_uniform(seed, "src", "dst") < F.col("p")).select("src", "dst", (1.0 / F.col("p")).alias("weight"))
