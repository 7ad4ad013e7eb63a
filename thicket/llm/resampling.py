"""Quality classifier by importance resampling (operator 1).

Hashed unigrams and bigrams of lower-cased words are counted over all documents (the raw model) and over a bounded sample
of labelled good documents (the target model).  A document's log weight is the log ratio of the two models, averaged over
its n-grams and scaled to a text of ``LENGTH`` n-grams, so that long texts don't outweigh short ones.  Documents are drawn
without replacement with these weights by Gumbel top-k: log weight plus seeded Gumbel noise, the k largest stay.  k is the
number of documents whose weight reaches the threshold that best parts good from bad in the labelled sample; the target model counts one half of the sample's good documents and the threshold is chosen on the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranked import kth
from ..storage import stored
from .exchange import PACKED, gathers, scatter, shuffled
from .textcore import U64, Words, word_chunks

#: Hashed n-grams: both models are arrays of this many bins.
BITS = 18
#: Bins are summed in so many buckets.
BUCKETS = 64
#: Labelled rows that the target model and the threshold are fitted on, at most; the sample is by hash of the id.
LABELLED = 20_000
#: Counts added to a bin's observed and expected target counts, which shrinks rare bins' ratios to 1.
SMOOTHING = 5.0
#: N-grams of the standard text that a weight stands for.
LENGTH = 200


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the unigrams and, at their first words, of the bigrams; a bigram at a text's last word is void (-1)."""
    shift = U64(64 - BITS)
    one = (words.hashes >> shift).astype(np.int64)
    two = np.full(len(one), -1, np.int64)
    if len(one) > 1:
        two[:-1] = (words.windows(2) >> shift).astype(np.int64)
    ends = words.first[1:] - 1
    two[ends[words.counts > 0]] = -1
    return one, two


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (bin, raw count, target count) of a task's documents."""
    size = 1 << BITS
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        good = np.array(batch.column("good").to_pylist(), bool)
        for a, b, words in word_chunks(batch, "text", lower=True):
            one, two = features(words)
            of = np.repeat(good[a:b], words.counts)
            for x in (one, two):
                raw += np.bincount(x[x >= 0], minlength=size)
                x = x[of]
                target += np.bincount(x[x >= 0], minlength=size)
    used = np.flatnonzero(raw)
    yield from scatter(np.stack([used, raw[used], target[used]], 1).astype(U64), used % BUCKETS)


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in gathers(batches, 3):
        bins, at = np.unique(got[:, 0].astype(np.int64), return_inverse=True)
        raw, target = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
        np.add.at(raw, at, got[:, 1].astype(np.int64))
        np.add.at(target, at, got[:, 2].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, raw, target)], names=["bins", "raw", "target"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bin, log of the target model over the raw one; all 0 without target text."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def _weigh(batches: Iterable[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    padded = np.append(ratio, 0.0)
    for batch in batches:
        n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for a, b, words in word_chunks(batch, "text", lower=True):
            one, two = features(words)
            # whole units of 2^-32, so that a sum doesn't hang on how texts are cut into chunks
            units = np.concatenate([[0], np.cumsum(np.round((padded[one] + padded[two]) * (1 << 32)).astype(np.int64))])
            n[a:b] = words.counts + np.maximum(words.counts - 1, 0)
            weight[a:b] = (units[words.first[1:]] - units[words.first[:-1]]) / (1 << 32) / np.maximum(n[a:b], 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight * LENGTH)], names=["doc_id", "n_grams", "log_weight"])


def threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts good from bad with the best balanced accuracy, halfway between its neighbours; of equals the
    lowest, and -inf if either kind is missing."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # cut i rejects the first i
    kept_good = 1 - np.r_[0, np.cumsum(g)] / g.sum()
    cut_bad = np.r_[0, np.cumsum(~g)] / (~g).sum()
    real = np.r_[True, w[1:] != w[:-1], True]
    score = np.where(real, np.round(kept_good + cut_bad, 12), -1)
    i = int(np.argmax(score))
    if i == 0:
        return float("-inf")
    return float(w[i - 1] + w[i]) / 2 if i < len(w) else float(np.nextafter(w[-1], np.inf))


def _gumbel(seed: int):
    """Gumbel noise of a row from its id, its number of n-grams and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "n_grams"), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_grams, log_weight, key, kept.

    labels(doc_id, quality, toxic) tell good documents (quality 1, not toxic) from bad (quality 0); rows with null ids or
    quality are not used, and an id with several labels counts by its worst.  Texts without words, or null, have weight 0.
    Half of the ids by hash fit the target model and the other half choose the threshold; without labels of both kinds
    there every document is kept.  Rows with equal keys share their fate, so repeated rows of one id
    and text stay or go together.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg((F.min("quality") >= 1).alias("fine"), (F.max(F.coalesce("toxic", F.lit(0))) < 1).alias("clean"))
    # the sample is bounded, so it may go to every executor; it is of ids that are among the documents
    some = told.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(LABELLED)
    some = stored(some.withColumn("fit", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)) == 0), "labelled")
    good = some.filter("fine AND clean AND fit").select("doc_id", F.lit(True).alias("good"))
    marked = rows.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = shuffled(marked.mapInArrow(_count, PACKED)).mapInArrow(_add, "bins binary, raw binary, target binary")
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for r in counts.collect():  # at most 2^BITS bins of 24 bytes
        bins = np.frombuffer(r["bins"], np.int64)
        raw[bins], target[bins] = np.frombuffer(r["raw"], np.int64), np.frombuffer(r["target"], np.int64)
    weighed = rows.mapInArrow(partial(_weigh, ratio=log_ratio(raw, target)), "doc_id long, n_grams long, log_weight double")
    weighed = stored(weighed.withColumn("key", F.col("log_weight") + _gumbel(seed)), "weighed")
    sample = weighed.join(F.broadcast(some.filter("NOT fit AND (clean OR NOT fine)")), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("w"), F.first("fine").alias("fine")).collect()  # LABELLED rows at most
    cut = threshold(np.array([r["w"] for r in sample]), np.array([r["fine"] for r in sample], bool))
    k = weighed.filter(F.col("log_weight") >= cut).count()
    last = kth(weighed.select((-F.col("key")).alias("minus")), ["minus"], k)
    return weighed.withColumn("kept", F.lit(False) if last is None else F.col("key") >= -last[0])


def kept_documents(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """docs without what resampled() rejects; all columns stay.  A document goes if any row of its id is rejected; those with
    a null id stay."""
    rejected = resampled(docs, labels, seed).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(rejected, docs["doc_id"].cast("long") == rejected["doc_id"], "left_anti")


