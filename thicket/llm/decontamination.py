"""Benchmark decontamination (operator 7): SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are what is left between ASCII spaces and punctuation after A-Z are lower-cased.  A benchmark item of L words is
sought in every window of L words of every text; both are bags of five-word shingles, weighted by how few items hold a
shingle.  A window of whose weight too little is in shingles of the benchmark can't reach the similarity with any item and
is passed over.  The others get a 64-bit SimHash.  The index holds every item of a length under each of six blocks of its
fingerprint and all their neighbours; the blocks' radii are such that every item within the radius of a window's SimHash is
found.  An item of which no shingle can lack at that similarity, as one of few words, has the radius 0: a window must have its very
fingerprint, which is one look-up among sorted ones.  Of what the index finds, only items of whose weight enough lies in the window
are compared, exactly, with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import U64, Words, as_bytes, chunks, in_sorted

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 20
#: Where the blocks of a fingerprint begin, and where the last one ends.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
#: Pairs of windows and items that are looked at together, and (item, place) pairs that bound what a window holds of an item.
PAIRS, PLACES = 1 << 22, 1 << 22
#: Fewer pairs than this are compared at once.
FEW = 16
#: Items of so many bytes are sought at a time; a larger benchmark takes several passes over the texts.
ITEM_BYTES = 8 << 20
_PLAIN = bytes(32 if x < 48 or 58 <= x < 65 or 91 <= x < 97 or 123 <= x < 128 else x for x in range(256))


def plain(text: bytes) -> bytes:
    """Punctuation and control characters of ASCII as spaces."""
    return text.translate(_PLAIN)


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of the running sums of weighted bits: row i of the result is the sum over the first i shingles."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum((2 * bits - 1) * weights[:, None].astype(np.int32), axis=0, out=sums[1:])
    return sums


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(U64)


class Index:
    """Benchmark items for search; ``items`` are (item_id, text) pairs.  All in arrays, so that it is sent as it is."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        words = Words([plain(t) for _, t in items], lower=True)
        windows = words.windows(WIDTH)
        ids, lengths, ordered, self.whole = [], [], [], {}
        for i, (item, _) in enumerate(items):
            n = int(words.counts[i])
            if n >= WIDTH:
                ids.append(item)
                lengths.append(n)
                ordered.append(windows[words.first[i] : words.first[i] + n - WIDTH + 1])
            elif n:
                # too few words for a shingle: only a text with just these words is the item
                self.whole.setdefault(bytes(words.of(words.hashes, i).tobytes()), []).append(item)
        self.ids, self.lengths = ids, np.array(lengths, np.int64)
        bags = [np.unique(x, return_counts=True) for x in ordered]
        #: distinct shingles of each item, in order, and how often it has them
        self.cut = np.cumsum([0, *(len(x) for x, _ in bags)])
        self.shingles, self.counts = (np.concatenate([np.zeros(0, t), *(x[k] for x in bags)]).astype(t) for k, t in ((0, U64), (1, np.int64)))
        self.known, held = np.unique(self.shingles, return_counts=True)
        #: whole numbers, so that sums are exact; a shingle that one item or none holds weighs unit
        self.unit = 64
        top = log(1 + len(ids)) or 1.0
        self.known_weight = np.array([max(1, round(self.unit * log(1 + len(ids) / n) / top)) for n in held.tolist()], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> U64(44)).astype(np.int64)] = True
        self.weight = self.weights(self.shingles)[0]
        sums = np.concatenate([[0], np.cumsum(self.weight * self.counts)])
        self.total = sums[self.cut[1:]] - sums[self.cut[:-1]]
        self.prints = np.array([packed(simhash(x, self.weights(x)[0]))[-1] for x in ordered], U64) if ordered else np.zeros(0, U64)
        # where the lightest shingle weighs more than may lack, a window that is like the item is the item
        lightest = np.minimum.reduceat(self.weight, self.cut[:-1]) if ordered else self.total
        same = lightest > (1 - similarity) * self.total * (1 + 1e-9)
        every = {n: np.flatnonzero(self.lengths == n) for n in np.unique(self.lengths).tolist()}
        self.least = {n: int(self.total[j].min()) for n, j in every.items()}
        self.of_length = {n: j[~same[j]] for n, j in every.items()}
        self.same_of = {n: (x := j[same[j]])[np.argsort(self.prints[x], kind="stable")] for n, j in every.items()}
        #: for each known shingle the items that have it
        owner = np.repeat(np.arange(len(ids)), np.diff(self.cut))
        order = np.argsort(self.shingles, kind="stable")
        self.holders, self.held = owner[order], np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
        # radii of the blocks, each one more, add up to more than the radius: a fingerprint within it is near in some block
        each, more = divmod(radius + 1, len(BLOCKS) - 1)
        self.radii = [each - (k >= more) for k in range(len(BLOCKS) - 1)]
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    def table(self, n: int, b: int) -> np.ndarray:
        """For each value of block b a row of bits: which items of n words are near."""
        if (n, b) not in self.tables:
            items, bits = self.of_length[n], BLOCKS[b + 1] - BLOCKS[b]
            near = np.array([sum(1 << x for x in c) for k in range(self.radii[b] + 1) for c in combinations(range(bits), k)], np.int64)
            table = np.zeros((1 << bits, (len(items) + 7) // 8), np.uint8)
            for k, v in enumerate(self.block(self.prints[items], b).tolist()):
                table[v ^ near, k >> 3] |= np.uint8(1 << (k & 7))
            self.tables[n, b] = table
        return self.tables[n, b]

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U64(BLOCKS[b])) & U64((1 << BLOCKS[b + 1] - BLOCKS[b]) - 1)).astype(np.int64)

    def candidates(self, n: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) of all items of n words within the radius of the windows' fingerprints, in pieces of bounded size."""
        items = self.same_of[n]
        if len(items):
            ours = self.prints[items]
            low = np.searchsorted(ours, prints)
            count = np.searchsorted(ours, prints, "right") - low
            yield np.repeat(np.arange(len(prints)), count), items[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)]
        items = self.of_length[n]
        step = max(1, PAIRS // max(1, len(items)))
        for at in range(0, len(prints) if len(items) else 0, step):
            some = prints[at : at + step]
            rows = np.zeros((len(some), (len(items) + 7) // 8), np.uint8)
            for b in range(len(BLOCKS) - 1):
                if self.radii[b] >= 0:
                    rows |= self.table(n, b)[self.block(some, b)]
            w, k = np.nonzero(np.unpackbits(rows, axis=1, bitorder="little")[:, : len(items)])
            close = np.bitwise_count(some[w] ^ self.prints[items[k]]) <= self.radius
            yield at + w[close], items[k[close]]

    def enough(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int, totals: np.ndarray, w: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of windows (of so many shingles from starts on, of these total weights) and items can be similar enough, by the weight
        of a window's shingles that the item has.  True for all where the shingles are too common to tell, or the pairs too few."""
        if len(w) < FEW:
            return np.ones(len(w), bool)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == shingles)
        n = self.held[at[place] + 1] - self.held[at[place]]
        if n.sum() > PLACES:
            return np.ones(len(w), bool)
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.held[at[place]], n)
        key = self.holders[pick] * (len(shingles) + 1) + np.repeat(place, n)
        order = np.argsort(key, kind="stable")
        key, sums = key[order], np.concatenate([[0], np.cumsum(np.repeat(weights[place], n)[order])])
        low = j * (len(shingles) + 1) + starts[w]
        most = sums[np.searchsorted(key, low + size)] - sums[np.searchsorted(key, low)]
        return most * (1 + self.similarity) >= self.similarity * (totals[w] + self.total[j]) * (1 - 1e-9)

    def weights(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of shingles, and which of them the benchmark has."""
        out, same = np.full(len(shingles), self.unit, np.int64), np.zeros(len(shingles), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            same = self.known[at] == shingles
            out[same] = self.known_weight[at[same]]
        return out, same

    def compare(self, shingles: np.ndarray, total: int, j: int) -> float:
        """Weighted Jaccard similarity of an item's bag and a window's, whose weight is total."""
        own = slice(self.cut[j], self.cut[j + 1])
        window = np.sort(shingles)
        there = np.searchsorted(window, self.shingles[own], "right") - np.searchsorted(window, self.shingles[own])
        both = int((self.weight[own] * np.minimum(there, self.counts[own])).sum())
        return both / (total + int(self.total[j]) - both)

    def search(self, words: Words, i: int, windows: np.ndarray, hit: bool) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, end word) of the items in a text, each at the first of its best windows."""
        a, n = int(words.first[i]), int(words.counts[i])
        if n < WIDTH:
            return [(item, 1.0, 0, n) for item in self.whole.get(words.of(words.hashes, i).tobytes(), [])] if n and self.whole else []
        if not hit:
            return []
        shingles = windows[a : a + n - WIDTH + 1]
        weights, known = self.weights(shingles)
        every, ours = (np.concatenate([[0], np.cumsum(x)]) for x in (weights, weights * known))
        out = []
        for length, items in self.of_length.items():
            # what a window and an item share is no more than the benchmark's shingles in the window, nor than the item
            least = self.similarity * self.least[length]
            if ours[-1] < least:
                continue
            size = min(length, n) - WIDTH + 1
            held, total = ours[size:] - ours[:-size], every[size:] - every[:-size]
            starts = np.flatnonzero((held >= least) & (held >= self.similarity * total))
            if not len(starts):
                continue
            best: dict[int, tuple[float, int]] = {}
            for block in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * size) + 1):
                for begin in range(0, len(block), 4096):
                    some = block[begin : begin + 4096]
                    low = int(some[0])
                    part = slice(low, int(some[-1]) + size)
                    sums = simhash(shingles[part], weights[part])
                    prints = packed(sums[some - low + size] - sums[some - low])
                    for w, j in self.candidates(length, prints):
                        fits = self.enough(shingles[part], weights[part], some - low, size, total[some], w, j)
                        for k, item in sorted(zip(w[fits].tolist(), j[fits].tolist(), strict=True)):
                            at = int(some[k])
                            x = self.compare(shingles[at : at + size], int(total[at]), item)
                            if x >= self.similarity and x > best.get(item, (0.0, 0))[0]:
                                best[item] = (x, at)
            out += [(self.ids[j], x, at, at + size + WIDTH - 1) for j, (x, at) in sorted(best.items())]
        return out

    def scan(self, texts: list[bytes]) -> Iterator[list[tuple[int, float, int, int]]]:
        for a, b in chunks(texts):
            words = Words([plain(t) for t in texts[a:b]], lower=True)
            windows = words.windows(WIDTH)
            hits = np.flatnonzero(self.maybe[(windows >> U64(44)).astype(np.int64)])
            hits = hits[in_sorted(windows[hits], self.known)]
            at = np.searchsorted(hits, words.first)
            for i in range(b - a):
                yield self.search(words, i, windows, bool(at[i + 1] > at[i]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, a bounded number of bytes at a time, streamed to the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"].encode("utf-8", "surrogatepass")))
        size += len(block[-1][1])
        if size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


_FOUND = "doc_id long, item_id long, similarity double, start_word long, end_word long"


def _indexes(benchmark: DataFrame, similarity: float, radius: int) -> Iterator[Broadcast]:
    """An index for each ITEM_BYTES of items, sent to each executor once; workers keep it, with its tables, between tasks."""
    for items in _blocks(benchmark):
        yield benchmark.sparkSession.sparkContext.broadcast(Index(items, similarity, radius))


def _find(batches: Iterable[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    index = held.value
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows = [(d, *x) for d, found in zip(ids, index.scan(as_bytes(batch.column("text"))), strict=True) for x in found]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word) of every item of benchmark(item_id, text) that a text of
    docs(doc_id, text) holds, at the first of its best windows.

    Null texts, items and item ids match nothing; an item of fewer than five words matches only a text of just these
    words; repeated rows of docs give repeated rows, repeated items one each; a null doc_id stays null.
    """
    out = docs.sparkSession.createDataFrame([], _FOUND)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for held in _indexes(benchmark, similarity, radius):
        out = out.unionByName(rows.mapInArrow(partial(_find, held=held), _FOUND))
    return out


def _drop(batches: Iterable[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    index = held.value
    for batch in batches:
        yield batch.filter(pa.array([not x for x in index.scan(as_bytes(batch.column("text")))], pa.bool_()))


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay, and so do rows with a null id or text."""
    for held in _indexes(benchmark, similarity, radius):
        docs = docs.mapInArrow(partial(_drop, held=held), docs.schema)
    return docs
