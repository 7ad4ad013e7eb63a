"""Ranked lexical search with block-max pruning (operator 12).

1. Documents are read once.  Rows that follow each other in the table form blocks of ``BLOCK`` documents; a block's forward
   index holds, for each document, the query set's terms it has and how often.  Texts don't move.
2. Counts over all documents (documents, terms, documents of a term) give the terms' weights and turn the forward index
   into impacts; each block then holds the greatest impact of each of its terms.
3. A query's bound for a block is the sum of weight times greatest impact.  The blocks with a query's highest bounds are
   scored first; the k-th best score found there is the query's threshold.
4. Each task goes through its blocks from the highest bound down, scores a block's documents for the queries whose bound reaches
   their threshold, and raises the thresholds by what it finds.  A block below every threshold isn't scored.
5. What tasks found at or above the thresholds meets by query, and the best k remain.

Scores are whole numbers, summed in doubles; they are exact below 2^53, as with items of fewer than 300,000 distinct terms.
64-bit hashes stand for terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .exchange import returned
from .textcore import U64, Words, as_bytes, chunks

#: Documents in a block, and blocks that are scored first for a query.
BLOCK, SEEDS = 32, 4
#: Bytes of item texts that are searched for at once; more are searched in turns.
ITEM_BYTES = 8 << 20
#: Parts of scores that a task adds up at once, found documents that it holds beside k for each query, and blocks that it sorts.
SUMS, FOUND, MEETING = 1 << 20, 1 << 16, 512
NULL_ID = -(1 << 63)
#: Bytes that aren't part of a term: all of ASCII but digits and letters.
GAP = np.zeros(256, bool)
GAP[:128] = [not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(128)]


# -- queries --------------------------------------------------------------------------------------------------------


class Queries:
    """Some items' distinct terms: a sorted vocabulary, and for each term the queries that have it."""

    def __init__(self, texts: list[bytes]):
        terms, owners = [], []
        for a, b in chunks(texts):
            words = Words(texts[a:b], lower=True, gap=GAP)
            terms.append(words.hashes)
            owners.append(np.repeat(np.arange(a, b), words.counts))
        pairs = np.unique(np.stack([np.concatenate(terms), np.concatenate(owners).astype(U64)], 1), axis=0) if terms else np.zeros((0, 2), U64)
        self.n = len(texts)
        self.vocabulary, counts = np.unique(pairs[:, 0], return_counts=True)
        self.begins = np.r_[0, np.cumsum(counts)]
        self.owners = pairs[:, 1].astype(np.int64)
        self.weights = np.zeros(len(self.vocabulary))

    def weigh(self, documents: int, holders: np.ndarray) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holders], np.float64)

    def expanded(self, terms: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, query) for each of the terms and each query that has it, of those wanted."""
        n = self.begins[terms + 1] - self.begins[terms]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begins[terms], n)
        place, query = np.repeat(np.arange(len(terms)), n), self.owners[at]
        if wanted is None:
            return place, query
        keep = wanted[query]
        return place[keep], query[keep]


def _queries(items: DataFrame, limit: int) -> Iterator[tuple[list[int | None], Queries]]:
    """All items in turns of about ``limit`` bytes of text."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        text = (r["text"] or "").encode()
        if size and size + len(text) > limit:
            yield ids, Queries(texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, Queries(texts)


# -- blocks ---------------------------------------------------------------------------------------------------------

#: A block: documents with a term and their terms, of all its documents; ids, lengths, ends and (term, times) of those with a
#: term of the queries.
_FORWARD = "block long, n_docs long, n_terms long, docs binary, lengths binary, ends binary, terms binary, times binary"


def _forward(batches: Iterable[pa.RecordBatch], vocabulary: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def block(some: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nonlocal number
        number += 1
        hit = [x for x in some if len(x[2])]
        arrays = (
            np.array([x[0] for x in hit], np.int64),
            np.array([x[1] for x in hit], np.int64),
            np.cumsum([len(x[2]) for x in hit], dtype=np.int64),
            np.concatenate([x[2] for x in hit]).astype(np.int32) if hit else np.zeros(0, np.int32),
            np.concatenate([x[3] for x in hit]).astype(np.int64) if hit else np.zeros(0, np.int64),
        )
        facts = (number - 1, sum(x[1] > 0 for x in some), sum(x[1] for x in some))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in facts] + [pa.array([x.tobytes()], pa.binary()) for x in arrays], names=[x.split()[0] for x in _FORWARD.split(", ")])

    for batch in batches:
        ids = batch.column("doc_id").fill_null(NULL_ID).to_pylist()
        texts = as_bytes(batch.column("text"))
        for a, b in chunks(texts):
            words = Words(texts[a:b], lower=True, gap=GAP)
            at = np.searchsorted(vocabulary, words.hashes)
            at[at == len(vocabulary)] = 0
            known = vocabulary[at] == words.hashes if len(vocabulary) else np.zeros(len(at), bool)
            for i in range(b - a):
                terms, times = np.unique(words.of(at, i)[words.of(known, i)], return_counts=True)
                held.append((ids[a + i], int(words.counts[i]), terms, times))
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
    if held:
        yield block(held)
    returned()


def _holders(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """How many documents hold each term, of those of a task; a document has a term once in its block."""
    counts = np.zeros(n, np.int64)
    for batch in batches:
        for terms in _arrays(batch, "terms"):
            counts += np.bincount(terms, minlength=n)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "holders"])


def _arrays(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The arrays of a binary column, a row each."""
    kind = np.int32 if column in ("terms", "held") else np.int64
    return (np.frombuffer(x.as_buffer(), kind) for x in batch.column(column))


_INDEX = "block long, docs binary, ends binary, terms binary, impacts binary, held binary, tops binary"


def _impacts(batches: Iterable[pa.RecordBatch], documents: int, all_terms: int) -> Iterator[pa.RecordBatch]:
    """Impacts of a block's (document, term) pairs, its distinct terms and their greatest impacts."""
    for batch in batches:
        rows = []
        for lengths, ends, terms, times in zip(*(_arrays(batch, c) for c in ("lengths", "ends", "terms", "times")), strict=True):
            # whole numbers of any size, as lengths times documents may pass 2^63
            m = np.array([50 + 50 * n * documents // all_terms for n in lengths.tolist()], np.int64)
            impacts = 1_000_000_000 * times // (1000 * times + 20 * np.repeat(m, np.diff(ends, prepend=0)))
            order = np.argsort(terms, kind="stable")
            held, first = np.unique(terms[order], return_index=True)
            tops = np.maximum.reduceat(impacts[order], first) if len(first) else impacts[:0]
            rows.append((impacts.tobytes(), held.tobytes(), tops.tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "docs", "ends", "terms")), *(pa.array(c, pa.binary()) for c in columns)], names=[x.split()[0] for x in _INDEX.split(", ")])


def bounds(queries: Queries, held: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """For each query the most that a document of the block can score."""
    place, query = queries.expanded(held)
    return np.bincount(query, tops[place] * queries.weights[held[place]], minlength=queries.n)


def scores(queries: Queries, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the document, query, score) of a block's documents and the wanted queries, where the score isn't 0."""
    per = (queries.begins[terms + 1] - queries.begins[terms]).cumsum() if len(terms) else np.zeros(0, np.int64)
    out, at = [], 0
    while at < len(ends):
        # as many documents as keep the sums few, one at least
        begin = ends[at - 1] if at else 0
        before = per[begin - 1] if begin else 0
        to = max(at + 1, int(np.searchsorted(per[ends - 1], before + SUMS, "right")))
        some = slice(begin, ends[to - 1])
        place, query = queries.expanded(terms[some], wanted)
        doc = np.searchsorted(ends, np.arange(some.start, some.stop), "right")[place]
        key, inverse = np.unique(doc * queries.n + query, return_inverse=True)
        total = np.bincount(inverse, impacts[some][place] * queries.weights[terms[some][place]], minlength=len(key))
        keep = total > 0
        out.append((key[keep] // queries.n, key[keep] % queries.n, total[keep].astype(np.int64)))
        at = to
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _together(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Slices of as many blocks as n queries' bounds leave room for."""
    size = max(1, min(MEETING, SUMS // max(1, n)))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _seeds(batches: Iterable[pa.RecordBatch], queries: Queries, most: int) -> Iterator[pa.RecordBatch]:
    """Each query's blocks with the highest bounds, of a task's blocks."""
    best = np.zeros((queries.n, 0)), np.zeros((queries.n, 0), np.int64)
    for batch in _together(batches, queries.n):
        found = [bounds(queries, held, tops) for held, tops in zip(_arrays(batch, "held"), _arrays(batch, "tops"), strict=True)]
        blocks = np.broadcast_to(batch.column("block").to_numpy(), (queries.n, len(found)))
        bound, block = np.hstack([best[0], np.stack(found, 1)]), np.hstack([best[1], blocks])
        order = np.lexsort((block, -bound))[:, :most]
        best = np.take_along_axis(bound, order, 1), np.take_along_axis(block, order, 1)
    query, place = np.nonzero(best[0] > 0)
    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[1][query, place]), pa.array(best[0][query, place])], names=["query", "block", "bound"])


class Best:
    """The k best documents of each query found so far: highest score first, then least id, unknown ids last."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.n, self.k, self.least = n, k, least.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[query]
        self.found.append((query[keep], doc[keep], score[keep]))
        self.size += int(keep.sum())
        if self.size > self.n * self.k + FOUND:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drops what can't be among the best k any more and raises the thresholds."""
        query, doc, score = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((doc, doc == NULL_ID, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        last = np.flatnonzero(rank == self.k - 1)
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        keep = rank < self.k
        self.found = [(query[keep], doc[keep], score[keep])]
        self.size = int(keep.sum())
        return self.found[0]


def _scored(batches: Iterable[pa.RecordBatch], queries: Queries, least: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query, doc, score) of the best k of each query at or above its threshold, of a task's blocks."""
    best = Best(queries.n, k, least)
    for batch in _together(batches, queries.n):
        blocks = list(zip(*(_arrays(batch, c) for c in ("docs", "ends", "terms", "impacts", "held", "tops")), strict=True))
        found = [bounds(queries, *b[4:]) for b in blocks]
        for i in sorted(range(len(blocks)), key=lambda i: -(found[i] / best.least).max(initial=0.0)):
            wanted = found[i] >= best.least
            if wanted.any():
                docs, ends, terms, impacts = blocks[i][:4]
                doc, query, score = scores(queries, ends, terms, impacts, wanted)
                best.add(query, docs[doc], score)
        best.settle()
    query, doc, score = best.settle()
    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc), pa.array(score)], names=["query", "doc_id", "score"])
    returned()


# -- the operator ---------------------------------------------------------------------------------------------------


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), (F.col("doc_id") == NULL_ID), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = BLOCK, seeds: int = SEEDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """For each row of items(item_id, text) its k best rows of docs(doc_id, text): item_id, rank (from 1), doc_id, score.

    Terms are the maximal runs of digits, ASCII letters (A-Z lower-cased) and all characters beyond ASCII.  N documents have a
    term, L is the number of all terms, n of a document's, df the documents that hold a term, tf its occurrences.  A term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))); with m = 50 + (50 n N) div L a document scores the sum of
    w ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms.  Only scores above 0 count; equal scores go by ascending
    doc_id, null last.  Null and empty texts have no terms: such documents count for nothing, such items find nothing.  Repeated
    documents are ranked each; repeated items or item ids have a ranking each.  Empty tables give no rows.  Other columns,
    whatever their names, are ignored.  block, seeds and item_bytes change how work is dealt, not the result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for ids, queries in _queries(items, item_bytes):
        forward = stored(rows.mapInArrow(partial(_forward, vocabulary=queries.vocabulary, size=block), _FORWARD), "forward")
        documents, all_terms = forward.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not documents or not len(queries.vocabulary):
            continue
        holders = np.zeros(len(queries.vocabulary), np.int64)
        # a number for each term of these items
        for r in forward.select("terms").mapInArrow(partial(_holders, n=len(holders)), "term long, holders long").groupBy("term").agg(F.sum("holders").alias("holders")).collect():
            holders[r["term"]] = r["holders"]
        queries.weigh(documents, holders)
        index = stored(forward.mapInArrow(partial(_impacts, documents=documents, all_terms=all_terms), _INDEX), "index")
        best = index.select("block", "held", "tops").mapInArrow(partial(_seeds, queries=queries, most=seeds), "query long, block long, bound double")
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))).filter(F.col("place") <= seeds)
        chosen = stored(best.select("block").distinct(), "seeds")  # a few blocks a query
        told = "query long, doc_id long, score long"
        first = index.join(F.broadcast(chosen), "block", "left_semi").mapInArrow(partial(_scored, queries=queries, least=np.ones(queries.n, np.int64), k=k), told)
        least = np.ones(queries.n, np.int64)
        for r in _top(first, k).filter(F.col("rank") == k).select("query", "score").collect():  # a row a query
            least[r["query"]] = r["score"]
        found = _top(index.mapInArrow(partial(_scored, queries=queries, least=least, k=k), told), k)
        names = spark.createDataFrame(list(enumerate(ids)), "query long, item_id long")
        found = found.join(F.broadcast(names), "query").select("item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = out.unionByName(found)
    return out
