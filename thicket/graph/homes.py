"""Rounds over a graph whose edges lie in homes, for algorithms that move labels of nodes.

Nodes lie in homes, runs of ids with about as many ends of edges, ``ENDS`` at most but for a hub's; a node's edges lie in its home's file in
the shared folder.  A round is a chain of steps in one job: in a step every home reads what it was sent, and sends rows to other
homes by the columns that it names.  The state of a home is written at the end of a round, and its steps read it from there.  Where tasks
can run side by side, all rounds are made in one stage instead (``gang``), in which tasks hold their homes; a graph of one home sends
rows to itself only.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import running_total
from ..storage import qualified, shared_folder, stored
from .blocks import ENDS, read_part, written
from .gang import HELD, Gang, places, shared

#: Fewer ends of edges than this are not dealt to several homes.
FEW = 1 << 18
_MESSAGE = "to int, sender int, payload binary"
_STATE = "home int, asked long, payload binary"

Arrays = dict[str, np.ndarray]


def packed_arrays(arrays: Arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(payload: bytes) -> Arrays:
    with np.load(io.BytesIO(payload)) as f:
        return dict(f.items())


def records(columns: Sequence[tuple[str, str]], *values: np.ndarray | int | float) -> np.ndarray:
    """Rows of these columns; a value that is no array is repeated."""
    out = np.zeros(next(len(v) for v in values if isinstance(v, np.ndarray)), np.dtype(list(columns)))
    for (name, _), v in zip(columns, values, strict=True):
        out[name] = v
    return out


def none(columns: Sequence[tuple[str, str]]) -> np.ndarray:
    return np.zeros(0, np.dtype(list(columns)))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin; the columns are in order."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spans(start: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of n rows."""
    return zip(start.tolist(), np.r_[start[1:], n][: len(start)].tolist(), strict=True)


def before(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of the values before each one in its run."""
    sums = np.cumsum(values) - values
    return sums - np.repeat(sums[start], np.diff(np.r_[start, len(values)]))


class Files(NamedTuple):
    nodes: str
    edges: str
    lists: str
    homes: int


class Home:
    """One home: ids and mass of its nodes; edges (a, b, w) from its a-th node to the b-th of the nodes touched, in order of b and a; and of
    each home that touches nodes of this one, which."""

    def __init__(self, files: Files, number: int, state: str | None = None, fixed: str | None = None):
        self.files, self.number, self.homes = files, number, files.homes
        self._state, self._fixed = state, fixed
        nodes = read_part(files.nodes, "home", number)
        self.ids, self.mass = (np.zeros(0, t) if nodes is None else nodes.column(c).to_numpy() for c, t in (("id", np.int64), ("mass", np.float64)))
        self.n = len(self.ids)

    @cached_property
    def _edges(self) -> tuple[np.ndarray, ...]:
        edges = read_part(self.files.edges, "home", self.number)
        dst, a, w = (np.zeros(0, t) if edges is None else edges.column(c).to_numpy() for c, t in (("dst", np.int64), ("at", np.int32), ("w", np.float64)))
        start = runs(dst)
        return a, np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(dst)])), w, dst[start]

    a = property(lambda self: self._edges[0])
    b = property(lambda self: self._edges[1])
    w = property(lambda self: self._edges[2])
    touched = property(lambda self: self._edges[3])

    def forget(self) -> None:
        """The edges are read again when they are needed next."""
        self.__dict__.pop("_edges", None)

    @cached_property
    def lists(self) -> dict[int, np.ndarray]:
        rows = read_part(self.files.lists, "home", self.number)
        if rows is None:
            return {}
        other, at = rows.column("other").to_numpy(), rows.column("at").to_numpy()
        start = runs(other)
        return {int(other[low]): at[low:high] for low, high in spans(start, len(other))}

    def _read(self, folder: str | None) -> Arrays:
        rows = None if folder is None else read_part(folder, "home", self.number, ["payload"])
        return {} if rows is None else _unpacked(rows.column(0)[0].as_py())

    @cached_property
    def state(self) -> Arrays:
        """What the last round left."""
        return self._read(self._state)

    @cached_property
    def fixed(self) -> Arrays:
        """What other rounds before these left."""
        return self._read(self._fixed)

    def sums(self, which: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, first, w): the weights of which edges to nodes of each label, in order of a and label; first is one of those nodes."""
        names, number = np.unique(label, return_inverse=True)
        key = self.a[which] * np.int64(max(1, len(names))) + number[self.b[which]]
        order = np.argsort(key)
        start = runs(key[order])
        edge = np.flatnonzero(which)[order[start]]
        w = np.add.reduceat(self.w[which][order], start) if len(start) else np.zeros(0)
        return self.a[edge], self.b[edge], w


class Sent:
    """What a home sends in a step."""

    def __init__(self, home: Home, **own: np.ndarray):
        self.home, self.rows = home, {home.number: own}

    def to(self, home: int, name: str, rows: np.ndarray) -> None:
        held = self.rows.setdefault(home, {})
        held[name] = np.concatenate([held[name], rows]) if name in held else rows

    def dealt(self, name: str, rows: np.ndarray, to: np.ndarray) -> None:
        """Each row to its home."""
        order = np.argsort(to, kind="stable")
        start = runs(to[order])
        for low, high in spans(start, len(to)):
            self.to(int(to[order[low]]), name, rows[order[low:high]])

    def owners(self, name: str, rows: np.ndarray, label: str = "label") -> None:
        """Each row to the home that keeps the books of its label."""
        self.dealt(name, rows, rows[label] % self.home.homes)

    def around(self, name: str, rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of the nodes ``at`` to the homes that touch them; each such home with the numbers of its rows."""
        where = np.full(self.home.n, -1)
        where[at] = np.arange(len(at))
        for other, theirs in self.home.lists.items():
            some = where[theirs]
            some = some[some >= 0]
            if len(some):
                self.to(other, name, rows[some])
                yield other, some


Step = Callable[[Home, Arrays], Sent]
Last = Callable[[Home, Arrays], tuple[int, Arrays]]


def _messages(sent: Sent) -> Iterator[pa.RecordBatch]:
    for to, arrays in sent.rows.items():
        yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([sent.home.number], pa.int32()), pa.array([packed_arrays(arrays)], pa.binary())], names=["to", "sender", "payload"])


def _together(got: list[tuple[int, bytes]]) -> Arrays:
    """What was sent, in the order of the senders, so that it is the same on every run."""
    return _joined([(sender, _unpacked(payload)) for sender, payload in sorted(got)])


def _joined(got: list[tuple[int, Arrays]]) -> Arrays:
    out: dict[str, list[np.ndarray]] = {}
    for _, arrays in got:
        for name, rows in arrays.items():
            out.setdefault(name, []).append(rows)
    return {name: np.concatenate(rows) if len(rows) > 1 else rows[0] for name, rows in out.items()}


def _received(batches: Iterable[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    got: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for to, sender, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            got.setdefault(to, []).append((sender, payload))
    return got


def _first(batches: Iterable[pa.RecordBatch], home: Callable[[int], Home], step: Step) -> Iterator[pa.RecordBatch]:
    for number in (n for batch in batches for n in batch.column(0).to_pylist()):
        yield from _messages(step(home(number), {}))


def _next(batches: Iterable[pa.RecordBatch], home: Callable[[int], Home], step: Step) -> Iterator[pa.RecordBatch]:
    for number, got in _received(batches).items():
        yield from _messages(step(home(number), _together(got)))


def _kept(number: int, asked: int, state: Arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([asked], pa.int64()), pa.array([packed_arrays(state)], pa.binary())], names=["home", "asked", "payload"])


def _ended(batches: Iterable[pa.RecordBatch], home: Callable[[int], Home], last: Last) -> Iterator[pa.RecordBatch]:
    for number, got in _received(batches).items():
        yield _kept(number, *last(home(number), _together(got)))


def _alone(batches: Iterable[pa.RecordBatch], home: Callable[[int], Home], steps: Sequence[Step], last: Last) -> Iterator[pa.RecordBatch]:
    """All rounds of a graph of one home; asked is the number of rounds in which something was."""
    for number in (n for batch in batches for n in batch.column(0).to_pylist()):
        here, done, asked = home(number), 0, 1
        while asked:
            got: Arrays = {}
            for step in steps:
                got = step(here, got).rows[number]
            asked, here.state = last(here, got)
            done += bool(asked)
        yield _kept(number, done, here.state)


def _side_by_side(batches: Iterable[pa.RecordBatch], home: Callable[[int], Home], steps: Sequence[Step], last: Last, homes: int, folder: str, held: bool) -> Iterator[pa.RecordBatch]:
    """All rounds, by tasks that each hold some homes; asked is the number of rounds in which something was, at the first home.
    held: edges stay in memory between steps."""
    for _ in batches:
        pass
    gang = Gang(folder)
    here, done, asked = {n: home(n) for n in shared(range(homes), gang)}, 0, 1
    while asked:
        got: dict[int, Arrays] = {n: {} for n in here}
        for step in steps:
            out: dict[int, list] = {}
            for number, own in here.items():
                if number in got:
                    for to, arrays in step(own, got[number]).rows.items():
                        out.setdefault(to % gang.size, []).append((to, number, arrays))
                    if not held:
                        own.forget()
            came: dict[int, list] = {}
            for to, sender, arrays in (row for rows in gang.swapped(out) for row in rows or ()):
                came.setdefault(to, []).append((sender, arrays))
            got = {to: _joined(sorted(rows, key=lambda r: r[0])) for to, rows in came.items()}
        mine = 0
        for number, arrays in got.items():
            more, here[number].state = last(here[number], arrays)
            mine += more
        asked = sum(gang.all_told(mine))
        done += bool(asked)
    for number, own in here.items():
        yield _kept(number, done if number == 0 else 0, own.state)


def _rows(batches: Iterable[pa.RecordBatch], home: Callable[[int], Home], rows: Callable[[Home], Arrays]) -> Iterator[pa.RecordBatch]:
    for number in (n for batch in batches for n in batch.column(0).to_pylist()):
        here = home(number)
        if here.n:
            yield from pa.table(rows(here)).to_batches()


class Homes:
    """Files of both(src, dst, w), edges of both directions without loops, and of nodes(id, mass); both are cheap to read again."""

    def __init__(self, both: DataFrame, nodes: DataFrame):
        self.spark = both.sparkSession
        ends = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
        ranges = stored(running_total(nodes.join(ends, "id", "left").select("id", "mass", (F.coalesce("d", F.lit(0)) + 1).alias("d")), "d", ["id"], "before"), "ranges")
        self.n, total = ranges.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        self.total = total
        self.homes = max(1, min(self.spark.sparkContext.defaultParallelism, -(-total // FEW)), -(-total // ENDS))
        places = ranges.select("id", "mass", F.floor(F.col("before") / F.lit(max(1, -(-total // self.homes)))).cast("int").alias("home"))
        places = places.withColumn("at", (F.row_number().over(Window.partitionBy("home").orderBy("id")) - 1).cast("int"))
        by_home, self.nodes = written(places.repartitionById(self.homes, "home").sortWithinPartitions("home", "at"), "home", "nodes")
        place = self.nodes.select("id", "home", "at")
        rows = both.join(place.withColumnRenamed("id", "src"), "src").select("home", "at", "dst", "w")
        edges, kept = written(rows.repartitionById(self.homes, "home").sortWithinPartitions("home", "dst", "at"), "home", "edges")
        touched = kept.select(F.col("home").alias("other"), F.col("dst").alias("id")).distinct().join(place, "id").select("home", "other", "at")
        lists, _ = written(touched.repartitionById(self.homes, "home").sortWithinPartitions("home", "other", "at"), "home", "lists")
        self.files = Files(by_home, edges, lists, self.homes)

    def _numbers(self) -> DataFrame:
        return self.spark.range(0, self.homes, 1, self.homes)

    def _end(self, rows: DataFrame) -> tuple[str, int]:
        seen, folder = Observation(), f"{shared_folder(self.spark)}/state"
        rows.observe(seen, F.sum("asked").alias("asked")).write.partitionBy("home").parquet(folder)
        return qualified(self.spark, folder), seen.get["asked"] or 0

    def _chain(self, sent: DataFrame, home: Callable[[int], Home], steps: Sequence[Step], last: Last) -> tuple[str, int]:
        for step in steps:
            sent = sent.repartitionById(self.homes, "to").mapInArrow(partial(_next, home=home, step=step), _MESSAGE)
        return self._end(sent.repartitionById(self.homes, "to").mapInArrow(partial(_ended, home=home, last=last), _STATE))

    def begun(self, rows: DataFrame, first: Callable[[Home, pa.Table], Sent], steps: Sequence[Step], last: Last) -> str:
        """The folder of the state that follows from rows(home, at, ...), a row a node."""
        home = partial(Home, self.files)
        sent = rows.repartitionById(self.homes, "home").mapInArrow(partial(_from_rows, home=home, first=first), _MESSAGE)
        return self._chain(sent, home, steps, last)[0]

    def round(self, state: str | None, steps: Sequence[Step], last: Last, fixed: str | None = None) -> tuple[str, int]:
        """The folder of the next state, and how many nodes asked."""
        home = partial(Home, self.files, state=state, fixed=fixed)
        sent = self._numbers().mapInArrow(partial(_first, home=home, step=steps[0]), _MESSAGE)
        return self._chain(sent, home, steps[1:], last)

    def rounds(self, state: str | None, steps: Sequence[Step], last: Last, fixed: str | None = None) -> tuple[str, bool]:
        """The folder of the state in which no node asks, and whether any did."""
        if self.homes == 1:
            home = partial(Home, self.files, state=state, fixed=fixed)
            folder, done = self._end(self._numbers().mapInArrow(partial(_alone, home=home, steps=steps, last=last), _STATE))
            return folder, done > 0
        tasks = min(self.homes, places(self.spark))
        if tasks:
            home = partial(Home, self.files, state=state, fixed=fixed)
            folder = qualified(self.spark, shared_folder(self.spark))
            work = partial(_side_by_side, home=home, steps=steps, last=last, homes=self.homes, folder=folder, held=self.total <= tasks * HELD)
            folder, done = self._end(self.spark.range(0, tasks, 1, tasks).mapInArrow(work, _STATE, barrier=True))
            return folder, done > 0
        moved = False
        while True:
            state, asked = self.round(state, steps, last, fixed)
            if not asked:
                return state, moved
            moved = True

    def rows(self, state: str, rows: Callable[[Home], Arrays], schema: str) -> DataFrame:
        """What each home makes of its state."""
        return self._numbers().mapInArrow(partial(_rows, home=partial(Home, self.files, state=state), rows=rows), schema)


def _from_rows(batches: Iterable[pa.RecordBatch], home: Callable[[int], Home], first: Callable[[Home, pa.Table], Sent]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        rows = pa.Table.from_batches(got)
        number = rows.column("home").to_numpy()
        for at in np.unique(number).tolist():
            yield from _messages(first(home(at), rows.filter(pa.array(number == at)).sort_by("at")))
