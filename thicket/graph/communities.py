"""Leiden on DataFrames, for graphs of any size: modularity or the constant Potts model (CPM).

Nodes move until none gains; the communities found are refined, the refined parts merged to the nodes of a smaller graph, and so on
there until every community is one node.  Then communities are split where they have fallen apart and nodes of the first graph
move again, until neither changes anything.  There is no limit of levels or rounds: every round raises the quality by more than
``GAIN``, or it is the last.

* Moves of a round are made together.  Each node finds its best community; of those that gain, a node moves only if it still
  gains after all moves of higher gain that could cost it: nodes that enter the same community or leave the same one (their
  masses), and neighbours that leave where it goes or enter where it comes from (their edges).  So a round's moves raise the
  quality together, and the best one is always made.
* Refinement starts from single nodes within each community.  A node that is still alone and well connected with its community
  joins a part that is well connected with it too, and of which it gains; a node that others join stays.

The edges of a level lie in homes (``homes``); a home knows the labels of its nodes and of those that its edges touch, and the volumes of these
communities.  A round is one job, in which nodes tell what changes: their moves to the homes that touch them, masses to the one that keeps
the books of the label.  So what moves is a row for each node and home that touches it at most, and less as fewer nodes move.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..storage import stored
from .components import component_labels
from .homes import Arrays, Home, Homes, Sent, Step, before, none, records, runs

#: The least rise of quality (in edge weights) that counts.
GAIN = 1e-9

_ASKED = (("at", "i4"), ("id", "i8"), ("now", "i8"), ("target", "i8"), ("delta", "f8"), ("lost", "f8"))
_NEAR = (("id", "i8"), ("now", "i8"), ("target", "i8"), ("delta", "f8"))
_CLAIM = (("label", "i8"), ("enters", "i1"), ("home", "i4"), ("at", "i4"), ("id", "i8"), ("delta", "f8"), ("mass", "f8"))
_CHARGE = (("at", "i4"), ("mass", "f8"))
_NEW = (("id", "i8"), ("label", "i8"))
_SHIFT = (("label", "i8"), ("mass", "f8"))
_HOLDER = (("label", "i8"), ("home", "i4"))
_VOLUME = (("label", "i8"), ("vol", "f8"))
_PART = (("label", "i8"), ("mass", "f8"), ("held", "i8"), ("outer", "f8"), ("comm_vol", "f8"))
_SIZE = (("label", "i8"), ("vol", "f8"), ("held", "i8"), ("open", "?"))
_JOIN = (("id", "i8"), ("to", "i8"), ("home", "i4"), ("at", "i4"), ("mass", "f8"), ("gain", "f8"))
_JOINED = (("at", "i4"), ("to", "i8"))


def _best(a: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Of each a, which are in order, where its gain is greatest, the first of equals."""
    start = runs(a)
    if not len(start):
        return start
    top = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, start), np.diff(np.r_[start, len(a)])))
    return top[runs(a[top])]


def _found(table: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The rows of a table, in order of its labels, for labels that it has."""
    return table[np.searchsorted(table["label"], labels)]


def _ordered(rows: np.ndarray, by: str) -> np.ndarray:
    return rows[np.argsort(rows[by], kind="stable")]


def _merged(rows: np.ndarray, *sums: str) -> np.ndarray:
    """A row a label, in order, with sums of these columns and any of the others."""
    names, first, number = np.unique(rows["label"], return_index=True, return_inverse=True)
    out = rows[first]
    for c in sums:
        out[c] = np.bincount(number, rows[c], len(names))
    return out


# a round of moves: ask, charge, move, count, learn


def _ask(home: Home, got: Arrays, rate: float) -> Sent:
    """Nodes that gain by a move tell it to the books of both communities and to the homes that touch them."""
    state, mass = _state(home), home.mass
    now, to = state["comm"], state["seen"]
    volume, to_volume = _found(state["volumes"], now)["vol"], _found(state["volumes"], to)["vol"]
    a, b, k = home.sums(np.ones(len(home.a), bool), to)
    here = to[b] == now[a]
    gain = k - rate * mass[a] * (to_volume[b] - np.where(here, mass[a], 0.0))
    stay = -rate * mass * (volume - mass)
    stay[a[here]] = gain[here]
    # alone a node has quality 0; where it is alone already it stays rather
    target, gained = state["fresh"].copy(), np.zeros(home.n)
    a, b, gain = a[~here], b[~here], gain[~here]
    top = _best(a, gain)
    top = top[gain[top] > 0]
    target[a[top]], gained[a[top]] = to[b[top]], gain[top]
    at = np.flatnonzero(gained - stay > GAIN)
    asked = records(_ASKED, at, home.ids[at], now[at], target[at], (gained - stay)[at], 0.0)
    sent = Sent(home, asked=asked)
    for enters, side in ((1, "target"), (0, "now")):
        sent.owners("claims", records(_CLAIM, asked[side], enters, home.number, at, asked["id"], asked["delta"], mass[at]))
    for _ in sent.around("near", records(_NEAR, *(asked[c] for c, _ in _NEAR)), at):
        pass
    return sent


def _charge(home: Home, got: Arrays) -> Sent:
    """The books tell a node what masses enter and leave before it; it finds what it loses by moves of neighbours that gain more."""
    asked, near = got.get("asked", none(_ASKED)), got.get("near", none(_NEAR))
    own, seen = np.full(home.n, -1), np.full(len(home.touched), -1)
    own[asked["at"]], seen[np.searchsorted(home.touched, near["id"])] = np.arange(len(asked)), np.arange(len(near))
    some = (own[home.a] >= 0) & (seen[home.b] >= 0)
    a, b, w = asked[own[home.a[some]]], near[seen[home.b[some]]], home.w[some]
    first = (b["delta"] > a["delta"]) | (b["delta"] == a["delta"]) & (b["id"] < a["id"])
    clash = ((b["now"] == a["target"]) | (b["target"] == a["now"])) & first
    lost = np.bincount(a["at"][clash], w[clash], home.n)
    asked["lost"] = lost[asked["at"]]
    sent = Sent(home, asked=asked)
    claims = got.get("claims", none(_CLAIM))
    claims = claims[np.lexsort((claims["id"], -claims["delta"], claims["enters"], claims["label"]))]
    sent.dealt("charges", records(_CHARGE, claims["at"], before(claims["mass"], runs(claims["label"], claims["enters"]))), claims["home"])
    return sent


def _shifted(home: Home, sent: Sent, at: np.ndarray, labels: np.ndarray, left: np.ndarray | None) -> Sent:
    """Nodes with new labels tell them to the homes that touch them, and to the books who has them now."""
    shift = records(_SHIFT, labels, home.mass[at])
    if left is not None:
        shift = np.concatenate([shift, records(_SHIFT, left, -home.mass[at])])
    sent.owners("shifts", _merged(shift, "mass"))
    held = [records(_HOLDER, np.unique(labels), home.number)]
    for other, some in sent.around("new", records(_NEW, home.ids[at], labels), at):
        held.append(records(_HOLDER, np.unique(labels[some]), other))
    sent.owners("holders", np.concatenate(held))
    return sent


def _move(home: Home, got: Arrays, rate: float) -> Sent:
    """Nodes move that still gain."""
    asked, charges = got["asked"], got.get("charges", none(_CHARGE))
    cost = rate * home.mass * np.bincount(charges["at"], charges["mass"], home.n)
    kept = asked[asked["delta"] - cost[asked["at"]] - asked["lost"] > GAIN]
    moved = records(_JOINED, kept["at"], kept["target"])
    return _shifted(home, Sent(home, asked=np.array([len(asked)]), moved=moved), kept["at"], kept["target"], kept["now"])


def _begin(home: Home, rows: pa.Table) -> Sent:
    """All nodes get their first labels."""
    comm, fresh, step = (rows.column(c).to_numpy() for c in ("comm", "fresh", "step"))
    sent = Sent(home, asked=np.zeros(1, np.int64), comm=comm, fresh=fresh, step=step[:1])
    return _shifted(home, sent, np.arange(home.n), comm, None)


def _state(home: Home) -> Arrays:
    empty = {c: np.zeros(0, np.int64) for c in ("comm", "fresh", "holders")}
    return home.state or {**empty, "step": np.zeros(1, np.int64), "seen": np.zeros(len(home.touched), np.int64), "volumes": none(_VOLUME), "books": none(_SHIFT)}


def _booked(home: Home, state: Arrays, got: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """The books of labels after shifts of their masses, and (label, home) of those that have held a label, as one number."""
    holders = got.get("holders", none(_HOLDER))
    books = _merged(np.concatenate([state["books"], got.get("shifts", none(_SHIFT))]), "mass")
    return books, np.unique(np.r_[state["holders"], holders["label"] * home.homes + holders["home"]])


def _count(home: Home, got: Arrays) -> Sent:
    """The books tell new volumes to all that hold the label."""
    sent = Sent(home, **{"asked": np.zeros(1, np.int64), **got})
    books, who = _booked(home, _state(home), got)
    who = who[np.isin(who // home.homes, got.get("shifts", none(_SHIFT))["label"])]
    sent.dealt("counted", records(_VOLUME, who // home.homes, _found(books, who // home.homes)["mass"]), who % home.homes)
    return sent


def _learn(home: Home, got: Arrays) -> tuple[int, Arrays]:
    """Labels are changed; a home has the volumes of all that it holds."""
    old = _state(home)
    state = {**old, **{c: got[c] for c in ("comm", "fresh", "step") if c in got}}
    moved, new = got.get("moved", none(_JOINED)), got.get("new", none(_NEW))
    state |= {c: state[c].copy() for c in ("comm", "fresh", "seen")}
    state["comm"][moved["at"]] = moved["to"]
    state["fresh"][moved["at"]] += state["step"][0]
    state["seen"][np.searchsorted(home.touched, new["id"])] = new["label"]
    state["books"], state["holders"] = _booked(home, old, got)
    labels = np.unique(np.r_[state["comm"], state["seen"]])
    state["volumes"] = records(_VOLUME, labels, 0.0)
    for told in (old["volumes"], got.get("counted", none(_VOLUME))):
        told = told[np.isin(told["label"], labels)]
        state["volumes"]["vol"][np.searchsorted(labels, told["label"])] = told["vol"]
    return int(got["asked"].sum()), state


class _Level(Homes):
    """A graph of one level; rate is what a unit of mass costs another one in the same community."""

    def __init__(self, both: DataFrame, nodes: DataFrame, rate: float):
        self.both, self.rate = stored(both, "both"), rate
        super().__init__(self.both, nodes)

    def moves(self) -> tuple[Step, ...]:
        return partial(_ask, rate=self.rate), _charge, partial(_move, rate=self.rate), _count


def _begun(level: _Level, state: DataFrame) -> str:
    return level.begun(state.select("home", "at", "comm", "fresh", "step"), _begin, (_count,), _learn)


def _labels(level: _Level, state: str, column: str = "comm") -> DataFrame:
    """(id, comm) of a state, or (id, part)."""
    return stored(level.rows(state, lambda home: {"id": home.ids, column: home.state[column]}, f"id long, {column} long"), "labels")


def _moves(level: _Level, state: DataFrame) -> DataFrame | None:
    """(id, comm) after one round on state(id, comm, mass, home, at, fresh, step), or None if no node gains; fresh is a label that no community has."""
    after, asked = level.round(_begun(level, state), level.moves(), _learn)
    return _labels(level, after) if asked else None


def _settled(level: _Level, state: DataFrame) -> tuple[str, bool]:
    """The state in which no node gains by a move, and whether any moved."""
    return level.rounds(_begun(level, state), level.moves(), _learn)


# a round of refinement: size up, open, join, rank, enter, become, hear


def _found_communities(home: Home) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Communities of the home's nodes and of those that its edges touch, and volumes."""
    return home.fixed["comm"], home.fixed["seen"], home.fixed["volumes"]


def _size_up(home: Home, got: Arrays, rate: float) -> Sent:
    """The parts that a home holds, with what the edges of its nodes to other parts of their community add up to."""
    comm, seen, volumes = _found_communities(home)
    part, near = home.state.get("part", home.ids), home.state.get("near", home.touched)
    some = (comm[home.a] == seen[home.b]) & (part[home.a] != near[home.b])
    outer = np.bincount(home.a[some], home.w[some], home.n)
    volume = _found(volumes, comm)["vol"]
    ready = home.state["ready"] if "ready" in home.state else outer >= rate * home.mass * (volume - home.mass)
    sent = Sent(home, part=part, near=near, ready=ready)
    sent.owners("parts", _merged(records(_PART, part, home.mass, 1, outer, volume), "mass", "held", "outer"))
    sent.owners("holders", records(_HOLDER, np.unique(np.r_[part, near]), home.number))
    return sent


def _open(home: Home, got: Arrays, rate: float) -> Sent:
    """The books tell sizes of parts, and which are well connected with their communities."""
    sent = Sent(home, **{c: got[c] for c in ("part", "near", "ready")})
    parts, holders = _merged(got.get("parts", none(_PART)), "mass", "held", "outer"), got.get("holders", none(_HOLDER))
    sizes = records(_SIZE, parts["label"], parts["mass"], parts["held"], parts["outer"] >= rate * parts["mass"] * (parts["comm_vol"] - parts["mass"]))
    sent.dealt("sizes", _found(sizes, holders["label"]), holders["home"])
    return sent


def _join(home: Home, got: Arrays, rate: float) -> Sent:
    """Of each node that is single, the part that it gains most by joining."""
    part, near, sizes = got["part"], got["near"], _ordered(got.get("sizes", none(_SIZE)), "label")
    comm, seen, _ = _found_communities(home)
    single, size = got["ready"] & (_found(sizes, part)["held"] == 1), _found(sizes, near)
    some = single[home.a] & size["open"][home.b] & (comm[home.a] == seen[home.b]) & (part[home.a] != near[home.b])
    a, b, k = home.sums(some, near)
    gain = k - rate * home.mass[a] * size["vol"][b]
    top = _best(a, gain)
    top = top[gain[top] > GAIN]
    joins = records(_JOIN, home.ids[a[top]], near[b[top]], home.number, a[top], home.mass[a[top]], gain[top])
    sent = Sent(home, **{c: got[c] for c in ("part", "near", "ready")}, asked=np.array([len(joins)]))
    sent.owners("joins", joins, "to")
    sent.owners("leaves", joins, "id")
    return sent


def _greatest(joins: np.ndarray, by: str) -> np.ndarray:
    """joins in order of a column, then by falling gain; of equals the lesser id goes first."""
    return joins[np.lexsort((joins["id"], -joins["gain"], joins[by]))]


def _ahead(joins: np.ndarray, others: np.ndarray, by: str, of: str) -> np.ndarray:
    """Which joins no other one is ahead of: others, in order of their column of, have one row for a value at most."""
    at = np.searchsorted(others[of], joins[by])
    there = at < len(others)
    there[there] = others[of][at[there]] == joins[by][there]
    out = np.ones(len(joins), bool)
    mine, other = joins[there], others[at[there]]
    out[there] = (mine["gain"] > other["gain"]) | (mine["gain"] == other["gain"]) & (mine["id"] < other["id"])
    return out


def _rank(home: Home, got: Arrays) -> Sent:
    """A node goes on unless one that would join it gains more."""
    joins, leaves = _greatest(got.get("joins", none(_JOIN)), "to"), _ordered(got.get("leaves", none(_JOIN)), "id")
    sent = Sent(home, **{c: got[c] for c in ("part", "near", "ready", "asked")}, leaves=leaves)
    sent.owners("joins", leaves[_ahead(leaves, joins[runs(joins["to"])], "id", "to")], "to")
    return sent


def _enter(home: Home, got: Arrays, rate: float) -> Sent:
    """Nor does it go on if its target moves and gains more; of those that enter a part together, all join that still gain."""
    joins = _greatest(got.get("joins", none(_JOIN)), "to")
    joins = joins[_ahead(joins, got["leaves"], "to", "id")]
    joins = joins[joins["gain"] - rate * joins["mass"] * before(joins["mass"], runs(joins["to"])) > GAIN]
    sent = Sent(home, **{c: got[c] for c in ("part", "near", "ready", "asked")})
    sent.dealt("joined", records(_JOINED, joins["at"], joins["to"]), joins["home"])
    return sent


def _become(home: Home, got: Arrays) -> Sent:
    joined, part = got.get("joined", none(_JOINED)), got["part"].copy()
    part[joined["at"]] = joined["to"]
    sent = Sent(home, part=part, **{c: got[c] for c in ("near", "ready", "asked")})
    for _ in sent.around("new", records(_NEW, home.ids[joined["at"]], joined["to"]), joined["at"]):
        pass
    return sent


def _hear(home: Home, got: Arrays) -> tuple[int, Arrays]:
    near, new = got["near"].copy(), got.get("new", none(_NEW))
    near[np.searchsorted(home.touched, new["id"])] = new["label"]
    return int(got["asked"].sum()), {"part": got["part"], "near": near, "ready": got["ready"]}


def _refined(level: _Level, state: str) -> DataFrame:
    """(id, part): well connected parts of the communities of a state, named by one of their nodes."""
    steps = [partial(f, rate=level.rate) for f in (_size_up, _open, _join)] + [_rank, partial(_enter, rate=level.rate), _become]
    return _labels(level, level.rounds(None, steps, _hear, state)[0], "part")


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def _above(level: _Level, parts: DataFrame) -> _Level:
    """The graph of the parts(id, part)."""
    a, b = parts.select(F.col("id").alias("src"), F.col("part").alias("a")), parts.select(F.col("id").alias("dst"), F.col("part").alias("b"))
    both = level.both.join(a, "src").join(b, "dst").filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
    nodes = level.nodes.join(parts, "id").groupBy(F.col("part").alias("id")).agg(F.sum("mass").alias("mass"))
    return _Level(both, nodes, level.rate)


def _connected(level: _Level, comm: DataFrame) -> DataFrame:
    """(id, comm): communities of comm(id, comm) split into their connected parts, named by their least node."""
    a, b = comm.select(F.col("id").alias("src"), F.col("comm").alias("a")), comm.select(F.col("id").alias("dst"), F.col("comm").alias("b"))
    inside = level.both.filter("src < dst").join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")
    return comm.select("id").join(component_labels(inside), "id", "left").select("id", F.coalesce("component", "id").alias("comm"))


def leiden_parallel(edges: DataFrame, resolution: float = 1.0, cpm: bool = False) -> DataFrame:
    """(id, comm) of every node of edges(src, dst[, weight]), canonical edges; comm is the least node of the community.

    Communities are connected, and no node gains by a move to another community or to one of its own.  Ties go by the larger
    gain, then by the lesser label, so the result is the same on every run.  No edges give no rows.
    """
    edges = stored(edges.select("src", "dst", (F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)).alias("w")), "edges")
    ids = stored(numbered(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), ["id"], "node"), "ids")
    n, total = ids.count(), 2.0 * (edges.agg(F.sum("w")).first()[0] or 0.0)
    if not n:
        return ids.select("id", F.col("id").alias("comm"))
    a, b = ids.select(F.col("id").alias("src"), F.col("node").alias("a")), ids.select(F.col("id").alias("dst"), F.col("node").alias("b"))
    dense = stored(edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "dense")
    ends = dense.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree"))
    base = _Level(_symmetric(dense.filter("src <> dst")), ends.select("id", (F.lit(1.0) if cpm else F.col("degree")).alias("mass")), resolution * (1.0 if cpm else 1.0 / total))

    def labelled(level: _Level, comm: DataFrame) -> DataFrame:
        """The state of comm(id, comm), whose labels are nodes; fresh labels are above them: 2n, 3n, ... and the node's id."""
        return level.nodes.join(comm, "id").select("id", "comm", "mass", "home", "at", (F.col("id") + 2 * n).alias("fresh"), F.lit(n).cast("long").alias("step"))

    level, member, start = base, base.nodes.select("id", F.col("id").alias("node")), base.nodes.select("id", F.col("id").alias("comm"))
    while True:
        settled, _ = _settled(level, labelled(level, start))
        state = _labels(level, settled)
        if state.select("comm").distinct().count() == level.n:
            break
        parts = _refined(level, settled)
        if not parts.filter("id <> part").limit(1).count():
            # nothing can be refined: the communities themselves are merged
            parts = state.join(state.groupBy("comm").agg(F.min("id").alias("part")), "comm").select("id", "part")
            parts = stored(parts, "parts")
        # a community goes on under the name of one of its parts
        named = state.select("id", "comm").join(parts, "id")
        named = named.join(named.groupBy("comm").agg(F.min("part").alias("label")), "comm")
        start = stored(named.select(F.col("part").alias("id"), F.col("label").alias("comm")).distinct(), "start")
        member = stored(member.join(parts.select(F.col("id").alias("node"), "part"), "node").select("id", F.col("part").alias("node")), "member")
        level = _above(level, parts)
    comm = member.join(state.select(F.col("id").alias("node"), "comm"), "node").select("id", "comm")
    while True:
        comm = stored(_connected(base, comm), "connected")
        state, moved = _settled(base, labelled(base, comm))
        if not moved:
            break
        comm = _labels(base, state)
    named = ids.withColumnRenamed("id", "name").join(comm.withColumnRenamed("id", "node"), "node")
    return named.join(named.groupBy("comm").agg(F.min("name").alias("least")), "comm").select(F.col("name").alias("id"), F.col("least").alias("comm"))
