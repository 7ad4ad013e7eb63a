"""The second smallest eigenvalue of a graph's normalised Laplacian, and its eigenvector, by Lanczos with re-orthogonalisation.

The eigenvalues of ``I - D^-1/2 A D^-1/2`` are 1 less those of ``S = D^-1/2 A D^-1/2``, whose greatest is 1 with the known
eigenvector ``sqrt(d)``.  Vectors that are orthogonal to it are built one after the other: a step is a product of the matrix, which
lies in blocks, with the last vector, and the products with all vectors so far, summed over the parts; a small linear system
takes their shares out exactly, though they are orthogonal only up to rounding.  A step writes a part's new vector and its product only;
of ``KEPT`` vectors the best Ritz vectors replace the basis and the iteration goes on (thick restart).  Where tasks can run side by side
and hold the edges and the basis, all steps are made in one stage (``gang``), and nothing is written.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hash_uniform
from ..storage import qualified, shared_folder, stored
from .blocks import Blocks, Files, Part, Work, packed, vectors, written
from .gang import HELD, Gang, places, shared

#: Vectors kept before a restart, and Ritz vectors that go on after it.
KEPT, GO_ON = 48, 12
#: Steps whose vectors lie in folders of their own, before a step writes all of them into one.
APART = 8
_STEP = "part int, q binary, w binary, sums array<double>"
#: Numbers of the basis that a task holds.
BASIS = 1 << 26


@dataclass
class _Basis:
    """Where the vectors lie: the folders of the steps since the last restart."""

    folders: tuple[str, ...]

    def of(self, part: Part) -> np.ndarray:
        return np.hstack([vectors(part, f, "q") for f in self.folders])


@dataclass
class _Step(Work):
    """The next vector, the last product without its shares of the others, and its product; before the first step there is the known vector
    and a random one.  mix: the vectors before are replaced by their mixtures; whole: all vectors are written."""

    basis: _Basis
    shares: np.ndarray
    length: float
    mix: np.ndarray | None = None
    whole: bool = True
    volume: float = 1.0

    def _all(self, part: Part) -> tuple[np.ndarray, int]:
        """The vectors, and how many of the first ones lie there already."""
        root = np.sqrt(part.columns["d"])
        if not self.basis.folders:
            return np.column_stack([root / self.volume**0.5, (part.columns["u"] - self.shares[0] * root) / self.length]), 0
        old = self.basis.of(part)
        new = (vectors(part, self.basis.folders[-1], "w") - (old @ self.shares)[:, None]) / self.length
        return np.hstack([old if self.mix is None else old @ self.mix, new]), 0 if self.whole else old.shape[1]

    def make(self, part: Part) -> np.ndarray:
        part.note = self._all(part)
        return part.note[0][:, -1:] / np.sqrt(part.columns["d"])[:, None]

    def done(self, part: Part, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, kept = part.note
        w = y[:, 0] / np.sqrt(part.columns["d"])
        yield packed(part, np.r_[w @ q, q[:, -1] @ q, w @ w], q=q[:, kept:], w=w)


@dataclass
class _Vector(Work):
    """The mixture of the basis, and the matrix times it."""

    basis: _Basis
    shares: np.ndarray

    def make(self, part: Part) -> np.ndarray:
        return (self.basis.of(part) @ self.shares)[:, None] / np.sqrt(part.columns["d"])[:, None]

    def done(self, part: Part, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = part.columns["d"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part.columns["id"], d, x[:, 0] * np.sqrt(d), y[:, 0] / np.sqrt(d))], names=["id", "d", "x", "w"])


class _Lead:
    """What follows from the products of the vectors, of which the first one is the known one."""

    def __init__(self, n: int, tolerance: float, steps: int):
        self.n, self.tolerance, self.left, self.settled = n, tolerance, steps, False
        self.gram, self.inner = np.eye(1), np.ones((1, 1))  # products of the vectors, and of the vectors with S times them

    def learned(self, sums: np.ndarray) -> tuple[np.ndarray, float, np.ndarray | None] | None:
        """Of the products of the last vector and of S times it with all: the shares of all in the latter, the length of the rest, and the mixtures
        that replace the vectors; None if ``found`` has settled or there are no more steps."""
        k = len(self.gram) + 1
        products, own, square = sums[:k], sums[k : 2 * k], sums[2 * k]
        self.gram = np.block([[self.gram, own[:-1, None]], [own[None, :-1], own[-1:, None]]])
        self.inner = np.block([[self.inner, products[:-1, None]], [products[None, :-1], products[-1:, None]]])
        shares = np.linalg.solve(self.gram, products)
        rest = max(0.0, square - shares @ products) ** 0.5
        # Ritz pairs among the vectors beside the first one
        low = np.linalg.cholesky(self.gram[1:, 1:])
        back = np.linalg.inv(low)
        values, ritz = np.linalg.eigh(back @ self.inner[1:, 1:] @ back.T)
        ritz = back.T @ ritz
        self.found, self.vector = float(values[-1]), np.r_[0.0, ritz[:, -1]]
        self.left -= 1
        self.settled = bool(rest * abs(ritz[-1, -1]) <= self.tolerance or k >= self.n or rest <= 1e-12)
        if self.settled or not self.left:
            return None
        mix = None
        if k >= KEPT:
            mix = np.zeros((k, GO_ON + 1))
            mix[0, 0], mix[1:, 1:] = 1.0, ritz[:, -GO_ON:]
            self.gram = mix.T @ self.gram @ mix
            self.inner = mix.T @ self.inner @ mix
        return shares, rest, mix


def multiplied(gang: Gang, parts: dict[int, Part], work: Work, x: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The matrix times x, of the parts that this task holds."""
    out: dict[int, list] = {}
    for number, part in parts.items():
        for block in part.blocks.values():
            if block.other != number:
                out.setdefault(block.other % gang.size, []).append((block.other, number, work.out(part, block, x[number])))
        for home, at in part.lists.items():
            out.setdefault(home % gang.size, []).append((home, number, x[number][at]))
    y = {number: work.local(part, x[number]) for number, part in parts.items()}
    for to, sender, got in (row for rows in gang.swapped(out) for row in rows or ()):
        part = parts[to]
        if sender in part.blocks:
            list(work.taken(part, part.blocks[sender], got, y[to], x[to]))
        else:
            y[to][part.lists[sender]] += got
    return y


def _side_by_side(batches: Iterable[pa.RecordBatch], files: Files, count: int, folder: str, lead: _Lead, share: float, length: float, volume: float) -> Iterator[pa.RecordBatch]:
    """All steps, by tasks that each hold some parts: what _Vector gives, and the value that was found."""
    for _ in batches:
        pass
    gang, work = Gang(folder), Work()
    parts = {n: part for n in shared(range(count), gang) if (part := Part(files, n)).n}
    root = {n: np.sqrt(part.columns["d"]) for n, part in parts.items()}
    basis = {n: np.column_stack([r / volume**0.5, (parts[n].columns["u"] - share * r) / length]) for n, r in root.items()}
    while True:
        y = multiplied(gang, parts, work, {n: q[:, -1:] / root[n][:, None] for n, q in basis.items()})
        w = {n: y[n][:, 0] / root[n] for n in parts}
        sums = [np.r_[w[n] @ q, q[:, -1] @ q, w[n] @ w[n]] for n, q in basis.items()]
        told = [s for some in gang.all_told(sums) for s in some]
        # one task goes on with the sums, so that all do the same
        step = gang.all_told((lead.learned(np.sum(told, axis=0)), lead) if gang.number == 0 else None)[0]
        if step[0] is None:
            lead = step[1]
            break
        shares, rest, mix = step[0]
        for n, q in basis.items():
            basis[n] = np.column_stack([q if mix is None else q @ mix, (w[n] - q @ shares) / rest])
    x = {n: (q @ lead.vector)[:, None] / root[n][:, None] for n, q in basis.items()}
    y = multiplied(gang, parts, work, x)
    for n, part in parts.items():
        columns = part.columns["id"], part.columns["d"], x[n][:, 0] * root[n], y[n][:, 0] / root[n], np.full(part.n, lead.found), np.full(part.n, lead.settled)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "d", "x", "w", "found", "settled"])


def laid(edges: DataFrame, seed: int = 42) -> Blocks:
    """The matrix of edges(src, dst), with a random vector."""
    return Blocks(edges, {"u": (hash_uniform(seed, "id") - 0.5) * F.sqrt("d")})


def second_eigenpair(edges: DataFrame, tolerance: float = 1e-6, seed: int = 42, steps: int = 1000) -> tuple[float, float, DataFrame]:
    """(lambda2, residual, vector) of edges(src, dst), canonical edges without loops: the second smallest eigenvalue of the
    normalised Laplacian; the length of ``L x - lambda2 x``, by which some eigenvalue is no farther than that; and the unit
    eigenvector as (id, d, x).

    0 if the graph is not connected.  A graph of one edge has the eigenvalue 2; ValueError without edges.  The iteration ends below
    the tolerance, or after so many steps with a warning.
    """
    return eigenpair_of(laid(edges, seed), tolerance, steps)


def gang_of(graph: Blocks) -> int:
    """How many tasks can hold the matrix side by side, or 0."""
    tasks = min(places(graph.spark), graph.parts)
    return tasks if graph.volume <= tasks * HELD and graph.n * KEPT <= tasks * BASIS else 0


def eigenpair_of(graph: Blocks, tolerance: float = 1e-6, steps: int = 1000) -> tuple[float, float, DataFrame]:
    """second_eigenpair of a matrix that is laid already."""
    n, volume = graph.n, float(graph.volume)
    if not n:
        raise ValueError("a graph without edges has no second eigenvalue")
    # the first vector is the known one, the second a random one without its share
    share = graph.nodes.agg(F.sum(F.col("u") * F.sqrt("d"))).first()[0] / volume
    length = graph.nodes.agg(F.sqrt(F.sum(F.pow(F.col("u") - F.lit(share) * F.sqrt("d"), 2)))).first()[0]
    lead, tasks = _Lead(n, tolerance, steps), gang_of(graph)
    if tasks:
        work = partial(_side_by_side, files=graph.files, count=graph.parts, folder=qualified(graph.spark, shared_folder(graph.spark)), lead=lead, share=share, length=length, volume=volume)
        both = stored(graph.spark.range(0, tasks, 1, tasks).mapInArrow(work, "id long, d double, x double, w double, found double, settled boolean", barrier=True), "vector")
        found, settled = both.select("found", "settled").first()
    else:
        basis, step = _Basis(()), _Step(_Basis(()), np.array([share]), length, volume=volume)
        while step is not None:
            folder, rows = written(graph.step(step, _STEP), "part", "step")
            basis = _Basis((folder,) if step.whole else (*basis.folders, folder))
            # a row a part
            after = lead.learned(np.sum([r["sums"] for r in rows.select("sums").collect()], axis=0))
            step = after and _Step(basis, *after, after[2] is not None or len(basis.folders) >= APART)
        found, settled = lead.found, lead.settled
        both = stored(graph.step(_Vector(basis, lead.vector), "id long, d double, x double, w double"), "vector")
    if not settled:
        warnings.warn(f"the eigenvector has not settled in {steps} steps", stacklevel=2)
    off = both.agg(F.sqrt(F.sum(F.pow(F.col("w") - F.lit(found) * F.col("x"), 2)))).first()[0]
    return 1.0 - found, off, both.select("id", "d", "x")


def lambda2(edges: DataFrame, tolerance: float = 1e-6, seed: int = 42) -> DataFrame:
    """One row: lambda2 and residual."""
    value, residual, _ = second_eigenpair(edges, tolerance, seed)
    return edges.sparkSession.createDataFrame([(value, residual)], "lambda2 double, residual double")
