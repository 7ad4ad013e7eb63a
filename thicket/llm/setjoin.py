"""N-gram Jaccard join by a token-group matrix (operator 10).

Documents are sets of distinct word shingles; two link when their Jaccard similarity reaches a threshold.  The join is
exact up to 64-bit hash collisions and returns connected components of the link graph:

1. Equal sets form one class, known by a fingerprint; the rest works on classes.
2. Shared-prefix pruning: in hash order, linked sets share at least j tokens among their first
   ``n - ceil(t n) + j`` ones.  Classes that share fewer with any other class are closed.  Each shared token votes for
   its least class as the leader of a group of similar classes.
3. Token sets of the open classes are read again from the texts.  Groups, split into cells of bounded size, are
   compared with a few members each (pivots) that go to all cells; links found join classes to clusters, parts of
   components.
4. Token-group matrix over clusters: the union of each cluster's tokens, inverted by token.  A cluster is open if at
   least ``ceil(t n)`` of its tokens, for its smallest n, are in other clusters' unions.
5. Members of open clusters query the groups, their own included, whose open members of other clusters have one of their
   rarest tokens.  A cell of a group is opened only if its union overlaps the query in ``ceil(t n)`` tokens; then its
   members are compared exactly.
6. Components of clusters are found by large-star and small-star steps.

Every shuffle carries tokens in packed arrays, a token that is frequent within one task is sent once, groups are split
into cells, and no step collects or emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranked import keyed_join
from ..graph.components import component_labels, near_labels
from ..storage import stored
from .exchange import PACKED, bucket_of, buckets_for, gathers, partitions, returned, runs, scatter, shuffled, signed
from .textcore import U64, mix, word_chunks

NULL_ID = -(1 << 63)
#: A token that so many classes of one task hold is sent once for all of them.
HOT = 64
#: Pairs of (token, class) that a task holds before it sends them on.
HELD = 1 << 19
#: Members in a cell of a group, members that a whole group is compared with, and queries that meet a cell at once.
CELL, PIVOTS, ASKED = 64, 16, 256


def ceil_share(n, percent: int):
    """ceil(percent n / 100) in whole numbers."""
    return -(-percent * n // 100)


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set of tokens."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        total = mix(tokens).sum(dtype=U64) + U64(len(tokens)) * U64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total ^ np.bitwise_xor.reduce(tokens)], U64))[0] >> U64(1))


def prefix_length(n: int, percent: int) -> int:
    """Tokens of step 2: j is a tenth of the set's size, one at least."""
    return min(n, n - ceil_share(n, percent) + max(1, n // 10))


# -- step 1 and 2 ---------------------------------------------------------------------------------------------------


def _send(tokens: np.ndarray, classes: np.ndarray, n: int, hot_from: int) -> Iterator[pa.RecordBatch]:
    """Records (kind, token, class): kind 1 as it is; kind 2 for a token whose holders are credited here already."""
    order = np.argsort(tokens, kind="stable")
    tokens, classes = tokens[order], classes[order]
    at, ends = runs(tokens)
    hot = np.flatnonzero(ends - at >= hot_from)
    single = np.ones(len(tokens), bool)
    sent, credits = [], []
    for k in hot.tolist():
        a, b = at[k], ends[k]
        least = classes[a:b].min()
        single[a:b] = False
        sent.append((2, tokens[a], least))
        credits.append(np.stack([classes[a:b], np.full(b - a, least, U64)], 1))
    records = np.stack([np.ones(int(single.sum()), U64), tokens[single], classes[single]], 1)
    if sent:
        records = np.concatenate([records, np.array(sent, U64)])
    yield from scatter(records, bucket_of(records[:, 1], n))
    if credits:
        pairs, count = np.unique(np.concatenate(credits), axis=0, return_counts=True)
        records = np.column_stack([np.full(len(pairs), 3, U64) | (count.astype(U64) << U64(8)), pairs])
        yield from scatter(records, bucket_of(pairs[:, 0], n))


def _shingle(batches: Iterable[pa.RecordBatch], width: int, percent: int, n: int, hot: int) -> Iterator[pa.RecordBatch]:
    held, owners, size, seen = [], [], 0, set()
    turn = 0
    for batch in batches:
        ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        marks = batch.column("mark").to_numpy().view(U64)
        found = []
        docs = np.zeros((len(ids), 3), U64)
        for a, b, words in word_chunks(batch, "text", lower=True):
            windows = words.windows(width)
            for i in range(b - a):
                tokens = words.shingles(i, windows, width)
                cls = class_of(tokens)
                docs[a + i] = (len(tokens) << 8, ids[a + i : a + i + 1].view(U64)[0], cls)
                if len(tokens) and cls not in seen:
                    seen.add(cls)
                    found.append((4, marks[a + i], cls))
                    some = tokens[: prefix_length(len(tokens), percent)]
                    held.append(some)
                    owners.append(np.full(len(some), cls, U64))
                    size += len(some)
            if size >= HELD:
                yield from _send(np.concatenate(held), np.concatenate(owners), n, hot)
                held, owners, size, seen = [], [], 0, set()
        if found:
            told = np.array(found, U64)
            yield from scatter(told, bucket_of(told[:, 2], n))
        yield from scatter(docs, (np.arange(len(docs)) // 256 + turn) % n)
        turn += len(docs) // 256 + 1
    if size:
        returned()
        yield from _send(np.concatenate(held), np.concatenate(owners), n, hot)


_FACTS = "kind int, a long, b long, c long"


def _facts(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), signed(a), signed(b), signed(c)], names=["kind", "a", "b", "c"])


def _credit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts: (0, doc_id, n, class); (1, class, leader, shared prefix tokens); (2, class, mark of a row that has it)."""
    for got in gathers(batches, 3):
        yield from _credited(got)


def _credited(got: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = got[:, 0] & U64(255)
    docs = got[kind == 0]
    if len(docs):
        yield _facts(0, docs[:, 1], docs[:, 0] >> U64(8), docs[:, 2])
    told = got[kind == 4]
    if len(told):
        yield _facts(2, told[:, 2], told[:, 1], np.zeros(len(told), U64))
    early = got[kind == 3]
    if len(early):
        yield _facts(1, early[:, 1], early[:, 2], early[:, 0] >> U64(8))
    got = got[(kind == 1) | (kind == 2)]
    if not len(got):
        return
    order = np.argsort(got[:, 1], kind="stable")
    got = got[order]
    same = np.flatnonzero(got[1:, 1] == got[:-1, 1])
    keep = np.zeros(len(got), bool)
    keep[same] = keep[same + 1] = True
    got = got[keep]
    if not len(got):
        return
    at, ends = runs(got[:, 1])
    least = np.minimum.reduceat(got[:, 2], at)
    greatest = np.maximum.reduceat(got[:, 2], at)
    lone = got[:, 0] & U64(255)
    # rows of one class alone (it was sent by several tasks) share nothing, unless a task has seen it shared
    wide = np.repeat((least != greatest) | (np.maximum.reduceat(lone, at) == 2), ends - at)
    leader = np.repeat(least, ends - at)
    # the least holder in a task, which stands for the others there, votes here too: so groups of several tasks meet
    pick = wide
    triples = np.stack([got[pick, 2], leader[pick], got[pick, 1]], 1)
    if not len(triples):
        return
    triples = triples[np.lexsort((triples[:, 2], triples[:, 1], triples[:, 0]))]
    new = np.r_[True, (triples[1:] != triples[:-1]).any(1)]
    pairs = triples[new][:, :2]
    at = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)])
    yield _facts(1, pairs[at, 0], pairs[at, 1], np.diff(np.r_[at, len(pairs)]).astype(U64))


# -- step 3 ---------------------------------------------------------------------------------------------------------


_SETS = "cls long, gid long, members long, n long, tokens binary"


def _tokens(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The token sets of the classes asked for; rows that only share a class's id, or repeat it, are passed over."""
    seen: set[int] = set()
    for batch in batches:
        cls, gid, members = (batch.column(c).to_pylist() for c in ("cls", "gid", "members"))
        for a, b, words in word_chunks(batch, "text", lower=True):
            windows = words.windows(width)
            rows = []
            for i in range(a, b):
                tokens = words.shingles(i - a, windows, width)
                if cls[i] not in seen and class_of(tokens) == cls[i]:
                    seen.add(cls[i])
                    rows.append((cls[i], gid[i], members[i], len(tokens), tokens.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.binary()), strict=True)], names=["cls", "gid", "members", "n", "tokens"])
    returned()


def _overlaps(queries: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes, (queries, members), by one merge of the members' tokens against each query."""
    flat = np.concatenate(members)
    order = np.argsort(flat, kind="stable")
    ordered, owner = flat[order], np.repeat(np.arange(len(members)), [len(m) for m in members])[order]
    out = np.zeros((len(queries), len(members)), np.int64)
    for q, x in enumerate(queries):
        lo = np.searchsorted(ordered, x)
        hi = np.searchsorted(ordered, x, "right")
        some = np.flatnonzero(hi > lo)
        if len(some):
            lo, length = lo[some], hi[some] - lo[some]
            index = np.repeat(lo - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            out[q] = np.bincount(owner[index], minlength=len(members))
    return out


def _links(overlap: np.ndarray, nq: np.ndarray, nm: np.ndarray, percent: int) -> np.ndarray:
    return (overlap > 0) & (100 * overlap >= percent * (nq[:, None] + nm[None, :] - overlap))


def _open_cells(batches: Iterable[pa.RecordBatch], percent: int, size: int) -> Iterator[pa.RecordBatch]:
    """Cells come sorted, each with its queries first.  Yields links (u, v) that span what is linked within a cell."""
    cell, queries, names, clusters, block, parent = None, [], [], [], [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def flush() -> list[tuple[int, int]]:
        if not block or not queries:
            return []
        members = [x for _, _, x in block]
        union = np.unique(np.concatenate(members))
        nq, nm = np.array([len(q) for q in queries]), np.array([len(m) for m in members])
        bound = np.array([np.count_nonzero(union[np.minimum(np.searchsorted(union, q), len(union) - 1)] == q) for q in queries])
        opened = np.flatnonzero(bound >= ceil_share(nq, percent))
        if not len(opened):
            return []
        linked = _links(_overlaps([queries[q] for q in opened], members), nq[opened], nm, percent)
        linked &= np.array([clusters[q] for q in opened])[:, None] != np.array([c for _, c, _ in block])[None, :]
        out = []
        for m in np.flatnonzero(linked.any(0)).tolist():
            first = None
            for q in opened[linked[:, m]].tolist():
                if first is None:
                    first = q
                    out.append((names[q], block[m][0]))
                elif find(first) != find(q):
                    parent[find(q)] = find(first)
                    out.append((names[q], block[m][0]))
        return out

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    found: list[tuple[int, int]] = []
    for batch in batches:
        gid, salt, part, query, cls, cluster = (batch.column(c).to_pylist() for c in ("gid", "salt", "part", "query", "cls", "cluster"))
        blobs = batch.column("tokens")
        for i in range(batch.num_rows):
            key = (gid[i], salt[i], part[i])
            if key != cell:
                found += flush()
                cell, queries, names, clusters, block, parent = key, [], [], [], [], []
            tokens = np.frombuffer(blobs[i].as_buffer(), U64)
            if query[i]:
                parent.append(len(queries))
                queries.append(tokens)
                names.append(cls[i])
                clusters.append(cluster[i])
            else:
                block.append((cls[i], cluster[i], tokens))
                if len(block) >= 2 * size:
                    found += flush()
                    block = []
        if found:
            yield batch_of(found)
            found = []
    found += flush()
    if found:
        yield batch_of(found)
    returned()


def _opened(queries: DataFrame, members: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between queries(gid, cells, parts, cls, cluster, tokens) and members (same columns) of the same group that are
    of different clusters.

    Members lie in ``cells`` cells of their group by a hash, its queries in ``parts`` parts; each part meets each cell.
    """

    def all_of(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    def one_of(count: str):
        return F.pmod(F.xxhash64("cls"), F.col(count))

    rows = members.select("gid", one_of("cells").alias("salt"), all_of("parts").alias("part"), F.lit(False).alias("query"), "cls", "cluster", "tokens").unionByName(
        queries.select("gid", all_of("cells").alias("salt"), one_of("parts").alias("part"), F.lit(True).alias("query"), "cls", "cluster", "tokens")
    )
    rows = rows.repartition(partitions(members.sparkSession), "gid", "salt", "part").sortWithinPartitions("gid", "salt", "part", F.desc("query"), "cls")
    return rows.mapInArrow(partial(_open_cells, percent=percent, size=size), "u long, v long")


# -- steps 4 and 5 --------------------------------------------------------------------------------------------------


def _unions(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Records (token, cluster), distinct within a task as far as it holds them."""
    held, size = [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]]
        yield from scatter(pairs, bucket_of(pairs[:, 0], n))

    for batch in batches:
        blobs = batch.column("tokens")
        for i, cluster in enumerate(batch.column("cluster").to_pylist()):
            tokens = np.frombuffer(blobs[i].as_buffer(), U64)
            held.append(np.stack([tokens, np.full(len(tokens), cluster, np.int64).view(U64)], 1))
            size += len(tokens)
            if size >= HELD:
                yield from sent()
                held, size = [], 0
    if size:
        yield from sent()


def _cluster_credit(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Records (cluster, how many of its tokens here other clusters hold too)."""
    for got in gathers(batches, 2):
        got = got[np.lexsort((got[:, 1], got[:, 0]))]
        got = got[np.r_[True, (got[1:] != got[:-1]).any(1)]]
        at, ends = runs(got[:, 0])
        clusters, count = np.unique(got[np.repeat(ends - at > 1, ends - at), 1], return_counts=True)
        yield from scatter(np.stack([clusters, count.astype(U64)], 1), bucket_of(clusters, n))


def _cluster_sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in gathers(batches, 2):
        clusters, at = np.unique(got[:, 0], return_inverse=True)
        yield pa.RecordBatch.from_arrays([signed(clusters), pa.array(np.bincount(at, got[:, 1].astype(np.float64)).astype(np.int64))], names=["cluster", "shared"])


def _members(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Records (token, class, cluster, group, members of the group << 32 | tokens of the class)."""
    held, size = [], 0
    for batch in batches:
        blobs = batch.column("tokens")
        for i, (cls, cluster, gid, members) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cls", "cluster", "gid", "members")), strict=True)):
            tokens = np.frombuffer(blobs[i].as_buffer(), U64)
            rest = np.array([cls, cluster, gid, (min(members, (1 << 31) - 1) << 32) | len(tokens)], np.int64).view(U64)
            held.append(np.column_stack([tokens, np.broadcast_to(rest, (len(tokens), 4))]))
            size += len(tokens)
            if size >= HELD // 2:
                both = np.concatenate(held)
                yield from scatter(both, bucket_of(both[:, 0], n))
                held, size = [], 0
    if size:
        both = np.concatenate(held)
        yield from scatter(both, bucket_of(both[:, 0], n))


def _spread(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """From tokens back to classes: (class, cluster, group, sizes, token, clusters that hold it), of tokens in two or more."""
    for got in gathers(batches, 5):
        got = got[np.lexsort((got[:, 2], got[:, 0]))]
        at, ends = runs(got[:, 0])
        new = np.r_[True, (got[1:, [0, 2]] != got[:-1, [0, 2]]).any(1)]
        df = np.repeat(np.add.reduceat(new.astype(np.int64), at), ends - at)
        pick = df > 1
        out = np.column_stack([got[pick][:, [1, 2, 3, 4, 0]], df[pick].astype(U64)])
        yield from scatter(out, bucket_of(out[:, 0], n))


def _rarest(batches: Iterable[pa.RecordBatch], percent: int, n: int) -> Iterator[pa.RecordBatch]:
    """Of each class that shares enough tokens, the rarest: (token, class, cluster, group, sizes)."""
    for got in gathers(batches, 6):
        got = got[np.lexsort((got[:, 4], got[:, 5], got[:, 0]))]
        at, ends = runs(got[:, 0])
        size = (got[at, 3] & U64(0xFFFFFFFF)).astype(np.int64)
        shared = ends - at
        length = shared - ceil_share(size, percent) + 1
        rank = np.arange(len(got)) - np.repeat(at, shared)
        out = got[rank < np.repeat(length, shared)][:, [4, 0, 1, 2, 3]]
        yield from scatter(out, bucket_of(out[:, 0], n))


def _ask(batches: Iterable[pa.RecordBatch], percent: int, n: int) -> Iterator[pa.RecordBatch]:
    """Queries as records (class, group): of two groups that hold a rare token the smaller one's classes ask the larger one, and the
    classes of a group ask their own, where a class of another cluster has the token."""
    for got in gathers(batches, 5):
        got = got[np.lexsort((got[:, 3], got[:, 0]))]
        asked, size = [], 0
        for a, b in zip(*(x.tolist() for x in runs(got[:, 0])), strict=True):
            cluster = got[a:b, 2]
            if b - a < 2 or (cluster == cluster[0]).all():
                continue
            cls, group, sizes = got[a:b, 1], got[a:b, 3], got[a:b, 4]
            members, count = sizes >> U64(32), (sizes & U64(0xFFFFFFFF)).astype(np.int64)
            need = ceil_share(count, percent)
            for lo, hi in zip(*(x.tolist() for x in runs(group)), strict=True):
                g, same = group[lo], cluster[lo:hi]
                other = cluster != same[0] if (same == same[0]).all() else np.ones(b - a, bool)
                ask = other & ((group == g) | (members < members[lo]) | ((members == members[lo]) & (group > g)))
                ask &= (count >= need[lo:hi].min()) & (need <= count[lo:hi].max())
                if ask.any():
                    asked.append(np.column_stack([cls[ask], np.full(int(ask.sum()), g, U64)]))
                    size += len(asked[-1])
            if size > HELD:
                asked = [np.unique(np.concatenate(asked), axis=0)]
                size = 0
        if asked:
            pairs = np.unique(np.concatenate(asked), axis=0)
            yield from scatter(pairs, bucket_of(pairs[:, 0], n))


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query once, though several tokens ask for it."""
    for got in gathers(batches, 2):
        pairs = np.unique(got, axis=0)
        yield pa.RecordBatch.from_arrays([signed(pairs[:, 0]), signed(pairs[:, 1])], names=["cls", "gid"])


# -- the operator ---------------------------------------------------------------------------------------------------


def _of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows(cls, gid, ...) with the columns of their groups(gid, count, ...); rows whose group is not there go."""
    groups = stored(groups, "groups")
    return keyed_join(rows, groups, "gid", groups.agg(F.sum("count")).first()[0] or 0, ["cls"])


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, hot: int = HOT, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Words are the runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased; a document's set has its distinct
    ``width``-word shingles, the whole sequence if it has fewer words, and nothing for a null text or one without words.
    Two documents link when 100 * intersection >= percent * union and neither set is empty; component_id is the least
    doc_id in the component, a document's own if it is alone.  Repeated rows and ids stay one row each; a row with a
    null doc_id is kept, links like others, and its component_id is null only if the component has no other id.
    Other columns, whatever their names, are ignored.  hot, cell and pivots change how work is dealt, not the result.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # tells rows apart where many have one id, or none
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    n = buckets_for(rows)

    packed = rows.mapInArrow(partial(_shingle, width=width, percent=percent, n=n, hot=hot), PACKED)
    facts = stored(shuffled(packed).mapInArrow(_credit, _FACTS), "facts")
    known = facts.filter("kind = 0").select(F.when(F.col("a") != NULL_ID, F.col("a")).alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("cls"))
    classes = known.groupBy("cls").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    votes = facts.filter("kind = 1").groupBy(F.col("a").alias("cls"), F.col("b").alias("leader")).agg(F.sum("c").alias("votes"))
    best = votes.groupBy("cls").agg(F.sum("votes").alias("shared"), F.max(F.struct("votes", (-F.col("leader")).alias("minus"))).alias("best"))
    need = F.greatest(F.lit(1).cast("long"), F.floor(F.ceil(F.col("n") * percent / 100.0) / 10))
    # a row that has the class's text
    marks = facts.filter("kind = 2").groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("mark"))
    survivors = best.join(classes.filter("n > 0"), "cls").filter(F.col("shared") >= need).join(marks, "cls").select("cls", (-F.col("best.minus")).alias("gid"), "mark")
    survivors = stored(survivors, "survivors")
    # the leader within a task may have a lesser leader
    above = survivors.filter("cls <> gid").select(F.col("cls").alias("gid"), F.col("gid").alias("top"))
    followed = _of_groups(survivors, survivors.groupBy("gid").agg(F.count("*").alias("count")).join(above, "gid", "left"))
    survivors = stored(followed.select("cls", F.coalesce("top", "gid").alias("gid"), "mark"), "survivors")
    sizes = survivors.groupBy("gid").agg(F.count("*").alias("count"))
    told = _of_groups(survivors, sizes).select("cls", "gid", "mark", F.col("count").alias("members"))
    sets = stored(rows.join(told, "mark").select("cls", "gid", "members", "text").mapInArrow(partial(_tokens, width=width), _SETS), "sets")

    cells = F.ceil(F.col("members") / cell).cast("long")
    grouped = sets.filter("members > 1").select("gid", "cls", "tokens", "members", cells.alias("cells"), F.lit(1).cast("long").alias("parts"), F.col("cls").alias("cluster"))
    chosen = (F.col("cls") == F.col("gid")) | (F.pmod(F.xxhash64("cls", F.lit(7)), F.col("members")) < pivots)
    links = stored(_opened(grouped.filter(chosen), grouped, percent, cell), "links")
    near = near_labels(links.select(F.col("u").alias("src"), F.col("v").alias("dst")))

    own = sets.select("cls", "n").distinct().join(near.select(F.col("id").alias("cls"), F.col("component").alias("cluster")), "cls", "left")
    own = stored(own.select("cls", "n", F.coalesce("cluster", "cls").alias("cluster")), "own")
    unions = sets.join(own.select("cls", "cluster"), "cls").select("cluster", "tokens").mapInArrow(partial(_unions, n=n), PACKED)
    shared = shuffled(shuffled(unions).mapInArrow(partial(_cluster_credit, n=n), PACKED)).mapInArrow(_cluster_sum, "cluster long, shared long")
    wide = own.groupBy("cluster").agg(F.min("n").alias("least"))
    open_ = wide.join(shared, "cluster").filter(F.col("shared") >= F.ceil(F.col("least") * percent / 100.0)).select("cluster")
    left = sets.join(own.join(open_, "cluster").select("cls", "cluster"), "cls")
    left = stored(left.select("cls", "cluster", "gid", "members", "tokens"), "open")
    packed = left.select("cls", "cluster", "gid", "members", "tokens").mapInArrow(partial(_members, n=n), PACKED)
    packed = shuffled(shuffled(packed).mapInArrow(partial(_spread, n=n), PACKED)).mapInArrow(partial(_rarest, percent=percent, n=n), PACKED)
    packed = shuffled(packed).mapInArrow(partial(_ask, percent=percent, n=n), PACKED)
    asked = stored(shuffled(packed).mapInArrow(_asked, "cls long, gid long"), "asked")
    parts = asked.groupBy("gid").agg(F.ceil(F.count("*") / ASKED).cast("long").alias("parts"))
    counts = left.groupBy("gid").agg(F.count("*").alias("count"))
    groups = stored(counts.join(parts, "gid").select("gid", (F.col("count") + F.col("parts") * ASKED).alias("count"), F.ceil(F.col("count") / cell).cast("long").alias("cells"), "parts"), "asked_groups")
    members = _of_groups(left, groups)
    queries = _of_groups(asked.join(left.drop("gid"), "cls"), groups)
    more = stored(_opened(queries, members, percent, cell), "more")

    final = component_labels(links.unionByName(more).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    every = classes.filter("n > 0").join(final.select(F.col("id").alias("cls"), "component"), "cls", "left")
    every = every.select("cls", F.coalesce("component", "cls").alias("comp"), "least", "copies")
    comps = stored(every.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows"), F.count("*").alias("count")).filter("rows > 1"), "comps")
    total, copies = comps.agg(F.sum("count"), F.sum("rows")).first()
    linked = keyed_join(every, comps, "comp", total or 0, ["cls"]).select("cls", F.col("copies").alias("count"), "component_id")
    # only linked classes have copies, and rows of none have no class to ask for
    told = keyed_join(known.filter("n > 0"), stored(linked, "linked"), "cls", copies or 0, ["doc_id"], how="left").select("doc_id", "n", "component_id")
    told = told.unionByName(known.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
