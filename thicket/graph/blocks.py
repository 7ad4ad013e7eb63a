"""A graph's adjacency matrix in blocks, for products with vectors that lie beside the nodes.

Nodes lie in parts: runs of ids that have ``ENDS`` ends of edges each, or fewer for as many parts as there are cores.  The edges
between two parts lie with the part of more nodes, their home, in a file that its task reads from the shared folder.  What
moves in a product is packed: the home gets a number for each node of the other part that its edges touch, and sends it a sum for each.
So a step is one exchange of at most that many numbers, however many edges there are, and no part's vector is gathered elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import running_total
from ..storage import qualified, shared_folder, stored

#: Ends of edges in a part, and rows of many columns that are gathered at once.
ENDS, CHUNK = 1 << 21, 1 << 15
_MESSAGE = pa.schema([("to", pa.int32()), ("sender", pa.int32()), ("payload", pa.binary())])


def read_part(folder: str, key: str, part: int, columns: list[str] | None = None) -> pa.Table | None:
    """The rows of a folder that were written by the key, in their order."""
    fs, base = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(f"{base}/{key}={part}", allow_not_found=True))
    tables = []
    for path in sorted(x.path for x in found if x.base_name.endswith(".parquet")):
        with fs.open_input_file(path) as f:
            tables.append(pq.ParquetFile(f).read(columns))
    return pa.concat_tables(tables) if tables else None


def written(df: DataFrame, key: str, name: str) -> tuple[str, DataFrame]:
    """df's rows in the shared folder, a folder for each value of the key: its URI, and the rows as read from there."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}"
    df.write.partitionBy(key).parquet(folder)
    return qualified(spark, folder), spark.read.schema(df.schema).parquet(folder)


def vectors(part: Part, folder: str, column: str) -> np.ndarray:
    """What a step wrote of the part in a binary column: a row a node."""
    return np.frombuffer(read_part(folder, "part", part.number, [column]).column(0)[0].as_buffer()).reshape(part.n, -1)


def packed(part: Part, sums: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A part's row of a step: part, the columns packed, and sums."""
    arrays = [pa.array([part.number], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in columns.values())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["part", *columns, "sums"])


def added(to: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """n rows: of each edge, row ``at`` of x is added to row ``to``."""
    if x.shape[1] == 1:
        return np.bincount(to, x[at, 0], n)[:, None]
    out = np.zeros((n, x.shape[1]))
    if len(to) and (to[1:] < to[:-1]).any():
        order = np.argsort(to, kind="stable")
        to, at = to[order], at[order]
    for low in range(0, len(to), CHUNK):
        t = to[low : low + CHUNK]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        out[t[first]] += np.add.reduceat(x[at[low : low + CHUNK]], first, axis=0)
    return out


class Block(NamedTuple):
    """Edges between a home and another part: ``a`` numbers nodes of the home, ``b`` those of the other's nodes that are touched, which
    ``touched`` gives in order; rows are the file's."""

    other: int
    a: np.ndarray
    b: np.ndarray
    touched: np.ndarray
    rows: pa.Table


class Part:
    """What lies in the files of one part; ``note`` is what ``make`` leaves for ``done``."""

    note = None

    def __init__(self, graph: Files, number: int):
        self.graph, self.number = graph, number
        nodes = read_part(graph.nodes, "part", number)
        self.n = 0 if nodes is None else nodes.num_rows
        self.columns = {} if nodes is None else {c: nodes.column(c).to_numpy() for c in nodes.column_names}

    @cached_property
    def blocks(self) -> dict[int, Block]:
        rows, out = read_part(self.graph.edges, "home", self.number), {}
        if rows is None:
            return out
        other, a, b = (rows.column(c).to_numpy() for c in ("other", "a", "b"))
        at = np.flatnonzero(np.r_[True, other[1:] != other[:-1]])
        for low, high in zip(at.tolist(), [*at[1:].tolist(), len(other)], strict=True):
            new = np.r_[True, b[low + 1 : high] != b[low : high - 1]]  # they are in order
            out[int(other[low])] = Block(int(other[low]), a[low:high], np.cumsum(new) - 1, b[low:high][new], rows.slice(low, high - low))
        return out

    @cached_property
    def lists(self) -> dict[int, np.ndarray]:
        """Of each home of edges that touch this part, the nodes that are touched."""
        rows = read_part(self.graph.lists, "other", self.number)
        if rows is None:
            return {}
        home, b = rows.column("home").to_numpy(), rows.column("b").to_numpy()
        at = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        return {int(home[low]): b[low:high] for low, high in zip(at.tolist(), [*at[1:].tolist(), len(home)], strict=True)}


class Files(NamedTuple):
    nodes: str
    edges: str
    lists: str


class Work:
    """What a task does with a part, in a step: ``make`` gives its vectors, of which ``k`` are multiplied; ``out`` the sums that a home
    sends to another part; ``local`` what it adds up from its own files; ``taken`` what it makes of another part's values; ``done`` its rows."""

    k = 1
    values = True

    def make(self, part: Part) -> np.ndarray | None:
        raise NotImplementedError

    def out(self, part: Part, block: Block, x: np.ndarray) -> np.ndarray | None:
        return added(block.b, block.a, x, len(block.touched))

    def local(self, part: Part, x: np.ndarray) -> np.ndarray:
        own = part.blocks.get(part.number)
        if own is None:
            return np.zeros((part.n, self.k))
        at = own.touched[own.b]
        return added(own.a, at, x, part.n) + added(at, own.a, x, part.n)

    def taken(self, part: Part, block: Block, got: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        y += added(block.a, block.b, got, part.n)
        return iter(())

    def done(self, part: Part, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def _send(batches: Iterable[pa.RecordBatch], files: Files, work: Work) -> Iterator[pa.RecordBatch]:
    message = lambda to, sender, x: pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([sender], pa.int32()), pa.array([x.tobytes()], pa.binary())], schema=_MESSAGE)
    for number in (n for batch in batches for n in batch.column(0).to_pylist()):
        part = Part(files, number)
        if not part.n:
            continue
        x = work.make(part)
        yield message(number, number, np.zeros(0))
        for block in part.blocks.values():
            sums = None if block.other == number else work.out(part, block, x)
            if sums is not None:
                yield message(block.other, number, sums)
        if work.values:
            for home, at in part.lists.items():
                yield message(home, number, np.ascontiguousarray(x[at]))


def _receive(batches: Iterable[pa.RecordBatch], files: Files, work: Work) -> Iterator[pa.RecordBatch]:
    part = x = y = None
    for batch in batches:
        for to, sender, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
            to, sender = to.as_py(), sender.as_py()
            if part is None or part.number != to:
                if part is not None:
                    yield from work.done(part, x, y)
                part = Part(files, to)
                x = work.make(part)
                y = work.local(part, x)
            got = np.frombuffer(payload.as_buffer())
            if sender == to:
                continue
            if sender in part.blocks:
                yield from work.taken(part, part.blocks[sender], got.reshape(len(part.blocks[sender].touched), -1), y, x)
            else:
                y[part.lists[sender]] += got.reshape(-1, work.k)
    if part is not None:
        yield from work.done(part, x, y)


def _each(batches: Iterable[pa.RecordBatch], files: Files, rows: Callable[[Part], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    for number in (n for batch in batches for n in batch.column(0).to_pylist()):
        part = Part(files, number)
        if part.n:
            yield from rows(part)


class Blocks:
    """The matrix of edges(src, dst), canonical edges without loops that are cheap to read again.  Columns of nodes, over id and d, and of
    edges, over src and dst, are written beside them; a column ``first`` tells whether an edge's src is the home's."""

    def __init__(self, edges: DataFrame, of_nodes: dict[str, Column] | None = None, of_edges: dict[str, Column] | None = None):
        self.spark: SparkSession = edges.sparkSession
        own = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        nodes = stored(running_total(own, "d", ["id"], "before"), "nodes")
        self.n, ends = nodes.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        self.volume = ends
        self.parts = max(self.spark.sparkContext.defaultParallelism, -(-ends // ENDS))
        places = nodes.select("id", "d", F.floor(F.col("before") / F.lit(max(1, -(-ends // self.parts)))).cast("int").alias("part"))
        within = Window.partitionBy("part")
        places = places.withColumn("at", (F.row_number().over(within.orderBy("id")) - 1).cast("int")).withColumn("many", F.count("*").over(within))
        by_part, self.nodes = written(places.withColumn("d", F.col("d").cast("double")).withColumns(of_nodes or {}).repartitionById(self.parts, "part").sortWithinPartitions("part", "at"), "part", "nodes")
        a, b = (self.nodes.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("part", "at", "many"))) for x in ("src", "dst"))
        first = F.struct("many_src", "part_src") >= F.struct("many_dst", "part_dst")
        home = lambda c, one, two: F.when(F.col("first"), F.col(f"{c}_{one}")).otherwise(F.col(f"{c}_{two}"))
        rows = edges.select("src", "dst").join(a, "src").join(b, "dst").withColumn("first", first)
        rows = rows.select(home("part", "src", "dst").alias("home"), home("part", "dst", "src").alias("other"), home("at", "src", "dst").alias("a"), home("at", "dst", "src").alias("b"), "first", *(c.alias(k) for k, c in (of_edges or {}).items()))
        by_home, kept = written(rows.repartitionById(self.parts, "home").sortWithinPartitions("home", "other", "b", "a"), "home", "edges")
        touched = kept.filter("home <> other").select("other", "home", "b").distinct()
        by_other, _ = written(touched.repartitionById(self.parts, "other").sortWithinPartitions("other", "home", "b"), "other", "lists")
        self.files = Files(by_part, by_home, by_other)

    def _numbers(self) -> DataFrame:
        return self.spark.range(0, self.parts, 1, self.parts)

    def step(self, work: Work, schema: str) -> DataFrame:
        """The rows of every part after one exchange."""
        sent = self._numbers().mapInArrow(partial(_send, files=self.files, work=work), "to int, sender int, payload binary")
        return sent.repartitionById(self.parts, "to").mapInArrow(partial(_receive, files=self.files, work=work), schema)

    def each(self, rows: Callable[[Part], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """The rows of every part, without an exchange."""
        return self._numbers().mapInArrow(partial(_each, files=self.files, rows=rows), schema)
