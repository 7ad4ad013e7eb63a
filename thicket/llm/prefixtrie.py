"""The prefix trie of conversations by an LCP-aware external mergesort (operator 13).

A conversation is a sequence of turn digests (16 bytes of each turn's role and text), so that byte order is turn order with
prefixes first.  Equal sequences are counted as one before anything is sorted.

1. Runs: each task sorts its sequences in runs of bounded size, stores with each the longest common prefix (LCP) with the one
   before it, and only the turns after that.  Splitters from a sample cut runs into ranges of bounded size; the runs'
   pieces lie in the shuffle's files.
2. Merge: a range's pieces meet in one task.  A loser tree merges them; it compares LCPs first and turns only from the LCP on,
   so that shared turns are compared once.
3. Nodes: the merged stream feeds a stack of open nodes, the path of the last sequence.  What the next sequence doesn't share
   is finished, added to its parent and put out.
4. Nodes on the first or last path of a range may go on in other ranges.  Their sums meet by node.  What counts once a
   node (its text, whether it is a leaf) is given to one of its ranges and summed up that range's path.

Members that end at a node are digested in the order of their ids: sorted over all nodes by ranges of (node, id), then written as
pieces of text, of which one task digests those of one node, as a digest is sequential.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranked import keyed_join
from ..storage import stored
from .exchange import partitions, returned

#: Bytes of a turn's digest; bytes of sequences in a run and, about, in a range.
TURN, RUN_BYTES, RANGE_BYTES = 16, 16 << 20, 16 << 20
#: Sample sequences that a range's splitter is taken from, and how many of their turns count.
SAMPLED, SPLIT_TURNS = 16, 16
#: Turns that are compared at once, and bytes of ids that are digested at once.
COMPARED, PIECE = 64, 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_digest(role: str = "role", text: str = "text"):
    """32 hex digits that tell turns apart by role and text."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


# -- sorted runs ----------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences share, of which so many are known to be."""
    n = min(len(a), len(b)) // TURN
    while known < n:
        to = min(n, known + COMPARED)
        x, y = a[known * TURN : to * TURN], b[known * TURN : to * TURN]
        if x != y:
            return known + next(i for i in range(to - known) if x[i * TURN : (i + 1) * TURN] != y[i * TURN : (i + 1) * TURN])
        known = to
    return n


#: A run's piece in a range: for each sequence its LCP, its turns, its members and the least of them, its name; turns
#: and text sizes after the LCP.
_PIECE = pa.schema([("range", pa.int32()), ("run", pa.int64()), *((x, pa.binary()) for x in ("lcps", "depths", "counts", "leasts", "names", "turns", "sizes"))])
_PIECES = "range int, run long, lcps binary, depths binary, counts binary, leasts binary, names binary, turns binary, sizes binary"


def _runs(batches: Iterable[pa.RecordBatch], splitters: list[bytes], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of (key, sizes, count, least, name), cut at the splitters."""
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0

    def run() -> Iterator[pa.RecordBatch]:
        nonlocal number
        number += 1
        held.sort(key=lambda x: x[0])
        at = 0
        while at < len(held):
            where = bisect_right(splitters, held[at][0])
            to = len(held)
            if where < len(splitters):
                low, high = at, len(held)
                while low < high:  # first sequence of a later range
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if held[mid][0] < splitters[where] else (low, mid)
                to = low
            piece = held[at:to]
            lcps = [0] + [common(a[0], b[0]) for a, b in zip(piece, piece[1:], strict=False)]
            columns = (
                np.array(lcps, np.int64).tobytes(),
                np.array([len(x[0]) // TURN for x in piece], np.int64).tobytes(),
                np.array([x[2] for x in piece], np.int64).tobytes(),
                np.array([x[3] for x in piece], np.int64).tobytes(),
                b"".join(x[4] for x in piece),
                b"".join(x[0][n * TURN :] for x, n in zip(piece, lcps, strict=True)),
                b"".join(x[1][n * 8 :] for x, n in zip(piece, lcps, strict=True)),
            )
            yield pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], schema=_PIECE)
            at = to

    for batch in batches:
        for key, sizes, count, least, name in zip(*(batch.column(c) for c in ("key", "sizes", "count", "least", "name")), strict=True):
            held.append((key.as_py(), sizes.values.to_numpy().astype(np.int64).tobytes() if len(sizes.values) else b"", count.as_py(), least.as_py(), name.as_py()))
            size += 2 * len(held[-1][0]) + 64
            if size >= most:
                yield from run()
                held, size = [], 0
    if held:
        yield from run()
    returned()


class Stream:
    """A run's piece, a sequence at a time.  lcp is how many turns the sequence shares with the one that was merged last."""

    def __init__(self, row: dict):
        self.columns = [np.frombuffer(row[c], np.int64) for c in ("lcps", "depths", "counts", "leasts", "sizes")]
        self.names, self.turns = row["names"], row["turns"]
        self.at, self.from_turn, self.key, self.lcp, self.done = -1, 0, b"", 0, False
        self.advance()

    def advance(self) -> None:
        self.at += 1
        lcps, depths = self.columns[:2]
        if self.at >= len(lcps):
            self.done, self.key = True, b""
            return
        self.lcp = self.own = int(lcps[self.at])
        more = int(depths[self.at]) - self.lcp
        self.key = self.key[: self.lcp * TURN] + self.turns[self.from_turn * TURN : (self.from_turn + more) * TURN]
        self.sizes_from = self.from_turn
        self.from_turn += more

    def size(self, depth: int) -> int:
        """Of the text of the turn at a depth beyond the LCP within the run, from 1."""
        return int(self.columns[4][self.sizes_from + depth - 1 - self.own])

    def entry(self) -> tuple[int, int, bytes]:
        return int(self.columns[2][self.at]), int(self.columns[3][self.at]), self.names[self.at * TURN : (self.at + 1) * TURN]


def beats(a: Stream, b: Stream) -> bool:
    """Whether a comes before b; the loser's lcp is then what it shares with the winner.  Both lcp are with the same sequence,
    which is not after either: who shares more of it comes first, and turns are compared only where they share as much."""
    if a.done or b.done:
        return not a.done
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    n = common(a.key, b.key, a.lcp)
    first = a.key[n * TURN : (n + 1) * TURN] <= b.key[n * TURN : (n + 1) * TURN]
    (b if first else a).lcp = n
    return first


def merged(streams: list[Stream]) -> Iterator[Stream]:
    """The streams in order of their sequences, each as its next one is merged, by a loser tree."""
    k = len(streams)
    losers: list[int] = [-1] * max(1, k)

    def play(node: int) -> int:
        """The winner below a node; leaves are k to 2k - 1."""
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        won, losers[node] = (a, b) if beats(streams[a], streams[b]) else (b, a)
        return won

    winner = play(1) if k > 1 else 0
    while not streams[winner].done:
        yield streams[winner]
        streams[winner].advance()
        node = (winner + k) // 2
        while node:
            if beats(streams[losers[node]], streams[winner]):
                winner, losers[node] = losers[node], winner
            node //= 2


# -- nodes ----------------------------------------------------------------------------------------------------------

#: kind: -1 for a finished node; else a node of the range's first (0) or last (1) path.  conv_id, n_convs and the sums are
#: those of the range; parent_conv is known where the parent is finished, parent names it where it is on a path.
_NODES = "kind int, range int, depth long, conv_id long, parent_conv long, parent binary, node binary, n_convs long, n_children long, n_leaves long, saved long, size long, name binary"
_NODE = pa.schema([("kind", pa.int32()), ("range", pa.int32()), *((x, pa.int64()) for x in ("depth", "conv_id", "parent_conv")), ("parent", pa.binary()), ("node", pa.binary()), *((x, pa.int64()) for x in ("n_convs", "n_children", "n_leaves", "saved", "size")), ("name", pa.binary())])


class Nodes:
    """The nodes of a range.  Sums of a finished node are whole; those of a node on a path are the range's part of them, without
    what counts once for each node on a path."""

    def __init__(self):
        self.depth, self.size, self.parent, self.least, self.count, self.children, self.leaves, self.saved = (array("q") for _ in range(8))
        self.names: dict[int, bytes] = {}
        self.stack: list[int] = []
        self.first: list[int] = []

    def open(self, size: int) -> None:
        i = len(self.depth)
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.depth.append(len(self.stack))
        self.size.append(size)
        self.least.append(0)
        for x in (self.count, self.children, self.leaves, self.saved):
            x.append(0)
        self.stack.append(i)

    def close(self, last: bool = False) -> None:
        i = self.stack.pop()
        up = self.parent[i]
        d = self.depth[i]
        on_path = last or (d < len(self.first) and self.first[d] == i)
        self.saved[i] += self.count[i] * self.size[i]
        if not on_path:
            self.saved[i] -= self.size[i]
            if not self.children[i]:
                self.leaves[i] = 1
        if up >= 0:
            self.least[up] = min(self.least[up], self.least[i]) if self.count[up] else self.least[i]
            self.count[up] += self.count[i]
            self.children[up] += not on_path
            self.leaves[up] += self.leaves[i]
            self.saved[up] += self.saved[i]

    def add(self, stream: Stream) -> None:
        """The next sequence, which shares stream.lcp turns with the one before."""
        while len(self.stack) > stream.lcp + 1:
            self.close()
        for depth in range(len(self.stack), len(stream.key) // TURN + 1):
            self.open(stream.size(depth) if depth else 0)
        if not self.first:
            self.first = list(self.stack)
        i = self.stack[-1]
        count, least, self.names[i] = stream.entry()
        self.least[i] = min(self.least[i], least) if self.count[i] else least
        self.count[i] += count


def _path(key: bytes) -> list[bytes]:
    """The names of a sequence's nodes, from the root: digests of its prefixes."""
    digest = hashlib.md5(usedforsecurity=False)
    out = [digest.digest()]
    for at in range(0, len(key), TURN):
        digest.update(key[at : at + TURN])
        out.append(digest.copy().digest())
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NODE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


def _of_range(number: int, streams: list[Stream]) -> Iterator[pa.RecordBatch]:
    nodes, first, last = Nodes(), None, b""
    for stream in merged(streams):
        first = stream.key if first is None else first
        last = stream.key
        nodes.add(stream)
    open_ = list(nodes.stack)
    while nodes.stack:
        nodes.close(last=True)
    named = dict(zip(nodes.first, _path(first or b""), strict=True)) | dict(zip(open_, _path(last), strict=True))
    rows, both = [], set(nodes.first)
    for kind, path in enumerate((nodes.first, open_)):
        for i in path:
            up = named[nodes.parent[i]] if nodes.parent[i] >= 0 else None
            # a node of both paths brings its sums once
            sums = (nodes.count[i], nodes.children[i], nodes.leaves[i], nodes.saved[i]) if kind == 0 or i not in both else (0, 0, 0, 0)
            rows.append((kind, number, nodes.depth[i], nodes.least[i], None, up, named[i], *sums, nodes.size[i], nodes.names.get(i)))
    yield _batch(rows)
    rows = []
    for i in range(len(nodes.depth)):
        if i in named:
            continue
        up = nodes.parent[i]
        rows.append((-1, number, nodes.depth[i], nodes.least[i], None if up in named else nodes.least[up], named.get(up), None, nodes.count[i], nodes.children[i], nodes.leaves[i], nodes.saved[i], nodes.size[i], nodes.names.get(i)))
        if len(rows) == 4096:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each range; pieces come ordered by range and run."""
    now, streams = None, []
    for batch in batches:
        for i, number in enumerate(batch.column("range").to_pylist()):
            if number != now and streams:
                yield from _of_range(now, streams)
                streams = []
            now = number
            streams.append(Stream({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
    if streams:
        yield from _of_range(now, streams)
    returned()


# -- members that end at a node ---------------------------------------------------------------------------------------


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the comma-joined ids of each name; rows come ordered by name and id, over all tasks."""
    part, piece = TaskContext.get().partitionId(), 0
    now, ids, size = None, [], 0

    def out() -> pa.RecordBatch:
        nonlocal piece
        piece += 1
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([part], pa.int32()), pa.array([piece], pa.int64()), pa.array([",".join(ids).encode()], pa.binary())], names=["name", "part", "piece", "ids"])

    for batch in batches:
        for name, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if now is not None and (name != now or size >= PIECE):
                yield out()
                ids, size = [], 0
            now = name
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield out()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's pieces, which come in order."""
    now, digest, done = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = name, hashlib.sha256(ids)
            else:
                digest.update(b",")
                digest.update(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["name", "ends_sha256"])
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(name, ends_sha256) of members(conv_id, name)."""
    n = partitions(members.sparkSession)
    ordered = members.select("name", "conv_id").repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = ordered.mapInArrow(_texts, "name binary, part int, piece long, ids binary")
    return pieces.repartition(n, "name").sortWithinPartitions("name", "part", "piece").select("name", "ids").mapInArrow(_digests, "name binary, ends_sha256 string")


# -- the operator ---------------------------------------------------------------------------------------------------


def shared_heads(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that share first turns, made from conversations(conv_id, turn, role, text): (conv_id, turns), turns an array of
    (digest, size), a digest of role and text and the text's code points.

    Turns go by turn, null first, those of one turn by their digest; null role or text is empty; rows without conv_id belong to
    no conversation.  A conversation c begins with the first h turns of conversation c - c % group, if there is one, all if
    it has fewer, h = crc32(c) % heads; its own turns after its first h follow.  One conversation is one row.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest().alias("digest"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"))
    own = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))
    own = stored(own.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns")), "own")
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int"))
    shared = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return convs.join(first, "base", "left").select("conv_id", F.concat(shared, rest).alias("turns"))


def prefix_trie(sequences: DataFrame, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per distinct first d turns of any row of sequences(conv_id, turns), d = 0 included: conv_id (the least member), depth,
    parent_conv_id (the parent's conv_id; null for the root), n_convs (members), n_children, n_leaves (childless nodes
    below it or itself), saved_tokens (summed over the subtree: members but one times the size of the node's last text), ends_sha256
    (of the members that have just d turns: their ids in ascending order, joined by commas).

    turns is an array of (digest, size), digest 32 hex digits, size a long.  Sequences without turns are members of the root; repeated
    conv_ids count each.  No rows give no nodes.  Sequences that are equal are merged as one, so any number of copies may be there;
    a sequence is one record and is held whole.  run_bytes and range_bytes change how work is dealt, not the result.
    """
    spark = sequences.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    members = sequences.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["size"]).alias("sizes"))
    members = stored(members.withColumn("name", F.unhex(F.md5("key"))), "members")
    distinct = members.groupBy("name").agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"), F.count("*").alias("count"), F.min("conv_id").alias("least"))
    distinct = stored(distinct, "sequences")
    n, size = distinct.agg(F.count("*"), F.sum(2 * F.length("key") + 64)).first()
    ranges = max(partitions(spark), -(-(size or 0) // range_bytes))
    some = distinct.select(F.substring("key", 1, SPLIT_TURNS * TURN).alias("key"))
    some = some.filter(F.pmod(F.xxhash64("name"), F.lit(1 << 20)) <= min(1.0, SAMPLED * ranges / max(n, 1)) * (1 << 20)) if n > SAMPLED * ranges else some
    keys = sorted(bytes(r["key"]) for r in some.collect())  # about SAMPLED short keys a range
    splitters = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []

    pieces = distinct.mapInArrow(partial(_runs, splitters=splitters, most=run_bytes), _PIECES)
    parts = partitions(spark)
    pieces = pieces.repartitionById(parts, F.pmod("range", F.lit(parts))).sortWithinPartitions("range", "run")
    nodes = stored(pieces.mapInArrow(_merge, _NODES), "nodes")

    # nodes on paths: sums of their ranges' parts, then what counts once
    paths = nodes.filter("kind >= 0")
    of = [F.max(x).alias(x) for x in ("depth", "parent", "size", "name")] + [F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved")]
    joint = stored(paths.groupBy("node").agg(F.min(F.struct("range", "kind")).alias("owner"), F.min("conv_id").alias("conv_id"), *of), "joint")
    more = joint.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("on_paths"))
    joint = stored(joint.join(more, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("on_paths", F.lit(0))).drop("on_paths"), "joint")
    own = paths.select("node", "range", "kind", "depth").join(joint.select("node", "owner", F.col("size").alias("once"), (F.col("n_children") == 0).cast("long").alias("leaf")), "node")
    owned = (F.col("owner.range") == F.col("range")) & (F.col("owner.kind") == F.col("kind"))
    up = Window.partitionBy("range", "kind").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    once = own.withColumns({c: F.when(owned, F.col(c)).otherwise(0) for c in ("once", "leaf")}).withColumns({c: F.sum(c).over(up) for c in ("once", "leaf")})
    once = once.groupBy("node").agg(F.sum("once").alias("once"), F.sum("leaf").alias("leaf"))
    above = joint.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("count"))
    on_paths = joint.join(once, "node").join(above.drop("count"), "parent", "left")
    on_paths = on_paths.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved") - F.col("once")).alias("saved_tokens"), "name")

    finished = nodes.filter("kind < 0").select("conv_id", "depth", "parent_conv", "parent", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "name")
    inner = finished.filter("parent IS NULL").withColumnRenamed("parent_conv", "parent_conv_id").drop("parent")
    # the few nodes on paths are told apart by a hash of their names
    outer = finished.filter("parent IS NOT NULL").drop("parent_conv").withColumn("parent", F.xxhash64("parent"))
    outer = keyed_join(outer, stored(above.withColumn("parent", F.xxhash64("parent")), "above"), "parent", n or 0, ["conv_id"]).drop("parent", "count")
    every = on_paths.unionByName(inner).unionByName(outer)
    ended = every.filter("name IS NOT NULL").join(_ends(members), "name").drop("name")
    return ended.unionByName(every.filter("name IS NULL").drop("name").withColumn("ends_sha256", F.lit(EMPTY_SHA)))
