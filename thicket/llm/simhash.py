"""SimHash near-duplicates by a self-join of a binary trie (operator 11).

A document's fingerprint has 64 bits, each the majority of that bit in the XXH64 hashes of its word shingles.  Distinct
fingerprints are the leaves of a binary trie; node pairs are traversed together from the root down:

1. A pair of nodes carries the differing bits of their prefixes.  It is dropped as soon as these exceed the budget.  Of
   two fingerprints within k bits one half differs in k // 2 bits at most, so the trie is walked twice, with the halves in
   either order, and the budget is k // 2 within the first half and k below it.
2. The upper levels are DataFrames: pairs whose nodes hold many fingerprints are expanded by some levels at once, by joins
   with the nodes that exist.  A node that holds a third of all fingerprints is so cut until its parts are small.
3. The fingerprints of a small node are one array; a task takes a pair of arrays and walks the lower levels, a batch of
   node pairs a step.  Node pairs of fingerprints that are known to be connected are dropped, so a dense ball of near
   copies doesn't yield all its pairs; the links put out span what is linked.
4. Components of fingerprints are found by large-star and small-star steps.

No step compares, collects or emits all pairs of a group, and copies of a fingerprint are one leaf.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranked import keyed_join
from ..graph.components import component_labels
from ..storage import stored
from .exchange import partitions, returned
from .textcore import CHUNK_BYTES, U64, as_bytes

BITS = 64
#: Fingerprints of a node that one task takes as an array, and levels that a larger node pair is expanded by.
LEAF, LEVELS = 1 << 13, 8
#: Node pairs that a task walks at once, that may wait, and pairs of fingerprints that are compared without going down any more.
WALKED, HELD_PAIRS, COMPARED = 1 << 13, 1 << 18, 256
#: Hashes whose bits are summed at once.
SUMMED = 1 << 14
_GAP = re.compile(rb"[\x20\x09-\x0d]")


# -- fingerprints ---------------------------------------------------------------------------------------------------


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in lists of about a chunk's bytes."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the width-word shingles, repeats included, words joined by a space; fewer words are one shingle."""
    rest: list[bytes] = []
    whole = False
    for words in _words(text):
        rest += words
        for at in range(0, len(rest) - width + 1, SUMMED):
            some = rest[at : at + SUMMED + width - 1]
            n = len(some) - width + 1
            joined = map(b" ".join, zip(*(some[k : k + n] for k in range(width)), strict=True))
            yield np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in joined), U64, n)
            whole = True
        if len(rest) >= width:
            rest = rest[len(rest) - width + 1 :]
    if not whole and rest:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(rest), seed)], U64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 for a text without words."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterable[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        prints = np.array([fingerprint(x, width, seed) for x in texts], U64)
        spot = np.arange(len(texts), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64)), pa.array(spot)], names=["doc_id", "print", "spot"])
    returned()


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, print (the fingerprint's bits as a long) and spot (of a row in its batch) of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_prints, width=width, seed=seed), "doc_id long, print long, spot int")


# -- the lower levels, in a task ------------------------------------------------------------------------------------


class Linked:
    """What is known to be connected among sorted fingerprints: a label for each place, and the links that led there."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []
        self._count()

    def _count(self) -> None:
        self.changes = np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])] if len(self.label) else np.zeros(0, np.int64)

    def one(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which ranges of places hold one label only."""
        return self.changes[lo] == self.changes[hi - 1]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        new = np.flatnonzero(a != b)
        if not len(new):
            return
        _, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[new], axis=0, return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while x in parent:
                if parent[x] in parent:
                    parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k in new[first].tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((int(i[k]), int(j[k])))
        to = np.arange(len(self.label))
        for x in parent:
            to[x] = find(x)
        self.label = to[self.label]
        self._count()


def budget(depth: int, bits: int) -> int:
    """Differing bits that node pairs of a depth may have."""
    return bits // 2 if depth <= BITS // 2 else bits


def _children(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the ranges lo to hi, whose fingerprints share their first depth bits, are cut by the next bit."""
    low = U64(BITS - depth - 1)
    border = ((x[lo] >> low) | U64(1)) << low
    return np.clip(np.searchsorted(x, border), lo, hi)


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, errors: int, bits: int) -> list[tuple[int, int]]:
    """Links between two nodes, sorted arrays whose fingerprints share depth bits and differ in errors bits there, or within
    one node (same: b is a).  Pairs of places (a, b) that span all that is linked, within the budgets of this trie."""
    known = Linked(len(a) if same else len(a) + len(b))
    shift = 0 if same else len(a)
    # node pairs yet to be walked, by errors and depth; the fewest errors go first, as they connect what the others then need not
    # compare, unless too many of more errors wait
    waiting: list[dict[int, list[np.ndarray]]] = [{} for _ in range(bits + 1)]
    held = [0] * (bits + 1)

    def wait(errors: int, depth: int, pairs: np.ndarray) -> None:
        if errors <= budget(depth, bits) and pairs.shape[1]:
            waiting[errors].setdefault(depth, []).append(pairs)
            held[errors] += pairs.shape[1]

    wait(errors, depth, np.array([[0], [len(a)], [0], [len(b)]], np.int64))
    while any(held):
        errors = next((e for e in range(bits, -1, -1) if held[e] > HELD_PAIRS), None)
        if errors is None:
            errors = next(e for e in range(bits + 1) if held[e])
        depth = max(waiting[errors])
        pairs = np.concatenate(waiting[errors].pop(depth), 1)
        held[errors] -= pairs.shape[1]
        wait(errors, depth, pairs[:, WALKED:])
        alo, ahi, blo, bhi = pairs = pairs[:, :WALKED]
        # what is connected already needs no more links
        settled = known.one(alo, ahi) & known.one(blo + shift, bhi + shift) & (known.label[alo] == known.label[blo + shift])
        alo, ahi, blo, bhi = pairs = pairs[:, ~settled]
        count = (ahi - alo) * (bhi - blo)
        compared = (count <= COMPARED) | (depth >= BITS)
        if compared.any():
            n = count[compared]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat((bhi - blo)[compared], n)
            i, j = np.repeat(alo[compared], n) + at // wide, np.repeat(blo[compared], n) + at % wide
            near = np.flatnonzero(np.bitwise_count(a[i] ^ b[j]) <= bits)
            if same:
                near = near[i[near] < j[near]]
            known.add(i[near], j[near] + shift)
        alo, ahi, blo, bhi = pairs[:, ~compared]
        if not len(alo):
            continue
        amid, bmid = _children(a, alo, ahi, depth), _children(b, blo, bhi, depth)
        equal = np.concatenate([np.stack([alo, amid, blo, bmid]), np.stack([amid, ahi, bmid, bhi])], 1)
        once = ~(same & (alo == blo))
        other = np.concatenate([np.stack([alo, amid, bmid, bhi]), np.stack([amid, ahi, blo, bmid])[:, once]], 1)
        for more, part in enumerate((equal, other)):
            if errors + more <= bits:
                wait(errors + more, depth + 1, part[:, (part[0] < part[1]) & (part[2] < part[3])])
    return [(i, j - shift) for i, j in known.links]


def _walks(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    half = U64(BITS // 2)
    for batch in batches:
        us, vs = [], []
        for r in zip(*(batch.column(c) for c in ("turn", "depth", "p", "q", "errors", "left", "right")), strict=True):
            turn, depth, p, q, errors = (x.as_py() for x in r[:5])
            a = np.sort(r[5].values.to_numpy().view(U64))
            b = a if p == q else np.sort(r[6].values.to_numpy().view(U64))
            found = np.array(walk(a, b, p == q, depth, errors, bits), np.int64).reshape(-1, 2)
            u, v = a[found[:, 0]], b[found[:, 1]]
            us.append((u << half | u >> half) if turn else u)
            vs.append((v << half | v >> half) if turn else v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["src", "dst"])
    returned()


# -- the upper levels, as DataFrames ---------------------------------------------------------------------------------


def _node(depth: int) -> Column:
    """The first depth bits of key."""
    return F.shiftrightunsigned("key", BITS - depth) if depth else F.lit(0).cast("long")


def _masks(levels: int, most: int) -> list[int]:
    """Numbers of so many bits with at most so many ones."""
    out = [0]
    for k in range(levels):
        out += [x | 1 << k for x in out if x.bit_count() < most]
    return out


def _expanded(pairs: DataFrame, nodes: DataFrame, levels: int, most: int) -> DataFrame:
    """Pairs of existing nodes (node, count) that are so many levels below pairs(turn, p, q, errors), with at most so many errors."""
    below = nodes.select("turn", F.shiftrightunsigned("node", levels).alias("p"), F.col("node").alias("child"), F.col("count").alias("np"))
    masks = F.array(*(F.lit(x).cast("long") for x in _masks(levels, most)))
    left = pairs.join(below, ["turn", "p"]).withColumn("mask", F.explode(F.filter(masks, lambda m: F.bit_count(m) + F.col("errors") <= most)))
    low = F.col("child") - F.shiftleft("p", levels)
    left = left.select("turn", F.col("child").alias("p"), "np", F.shiftleft("q", levels).bitwiseOR(low.bitwiseXOR(F.col("mask"))).alias("node"), (F.col("errors") + F.bit_count("mask")).cast("int").alias("errors"), (F.col("p") == F.col("q")).alias("twice"))
    both = left.filter("NOT twice OR p <= node").join(nodes.withColumnRenamed("count", "nq"), ["turn", "node"])
    return both.select("turn", "p", F.col("node").alias("q"), "errors", "np", "nq")


def near_links(prints: DataFrame, n: int, bits: int = 3, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """(src, dst) that connect what is linked: distinct prints(print), n of them, link at ``bits`` or fewer differing bits."""
    spark = prints.sparkSession
    turned = F.shiftleft("print", BITS // 2).bitwiseOR(F.shiftrightunsigned("print", BITS // 2))
    keys = F.array(F.struct(F.lit(0).alias("turn"), F.col("print").alias("key")), F.struct(F.lit(1).alias("turn"), turned.alias("key")))
    keys = prints.select(F.inline(keys))
    depth, step = 0, min(BITS // 2, max(0, (n - 1) // leaf).bit_length())
    pairs = spark.range(2).select(F.col("id").cast("int").alias("turn"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("errors"))
    links = None
    while True:
        depth += step
        nodes = keys.groupBy("turn", _node(depth).alias("node")).agg(F.count("*").alias("count"))
        pairs = stored(_expanded(pairs, stored(nodes, "nodes"), step, budget(depth, bits)), "pairs")
        small = pairs.filter((F.col("np") + F.col("nq") <= 2 * leaf) | F.lit(depth == BITS))
        ends = small.select("turn", F.explode(F.array("p", "q")).alias("node")).distinct()
        arrays = stored(keys.withColumn("node", _node(depth)).join(ends, ["turn", "node"], "left_semi").groupBy("turn", "node").agg(F.collect_list("key").alias("prints")), "arrays")
        work = small.join(arrays.select("turn", F.col("node").alias("p"), F.col("prints").alias("left")), ["turn", "p"])
        work = work.join(arrays.select("turn", F.col("node").alias("q"), F.col("prints").alias("right")), ["turn", "q"])
        work = work.select("turn", F.lit(depth).alias("depth"), "p", "q", "errors", "left", "right").repartition(partitions(spark), "turn", "p", "q")
        found = stored(work.mapInArrow(partial(_walks, bits=bits), "src long, dst long"), "links")
        links = found if links is None else links.unionByName(found)
        pairs = pairs.filter(F.col("np") + F.col("nq") > 2 * leaf).select("turn", "p", "q", "errors")
        if depth == BITS or not pairs.limit(1).count():
            return links
        step = min(levels, BITS - depth, BITS // 2 - depth if depth < BITS // 2 else BITS)


# -- the operator ---------------------------------------------------------------------------------------------------


def simhash_components(docs: DataFrame, width: int = 3, bits: int = 3, seed: int = 42, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Words are the runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased; shingles are ``width`` words joined by a space,
    repeats included, the whole sequence if there are fewer words.  A fingerprint bit is set if it is in over half the
    shingles' XXH64 hashes (a tie is 0); a null text or one without words has fingerprint zero, which links like any other.
    Documents link when their fingerprints differ in ``bits`` bits at most; component_id is the least doc_id in the component.
    Repeated rows and ids stay one row each; a row with a null doc_id is kept, and its component_id is null only if the
    component has no other id.  No rows give no rows.  Texts of any length are hashed whole, in pieces.  Other columns, whatever
    their names, are ignored.  leaf and levels change how work is dealt, not the result.
    """
    rows = stored(fingerprints(docs, width, seed), "prints")
    classes = stored(rows.groupBy("print").agg(F.count("*").alias("count"), F.min("doc_id").alias("least")), "classes")
    n, total = classes.agg(F.count("*"), F.sum("count")).first()
    if not n:
        return rows.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    links = near_links(classes.select("print"), n, bits, leaf, levels)
    final = component_labels(links).withColumnRenamed("id", "print")
    every = stored(classes.join(final, "print", "left").select("print", F.coalesce("component", "print").alias("comp"), "least", F.col("count").alias("copies")), "every")
    comps = stored(every.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("count")), "comps")
    told = keyed_join(every, comps, "comp", n, ["print"]).select("print", F.col("copies").alias("count"), "component_id")
    out = keyed_join(rows, stored(told, "told"), "print", total, ["doc_id", "spot"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
