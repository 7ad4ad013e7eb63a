"""Mixing sources to target weights (operator 2) by subset-sum budget fitting.

Each source gets a target of words.  Whole passes over the source come first; the rest of the budget is fitted with one
more copy of some documents.  For that the source's documents are counted by exact length, and a bounded-knapsack dynamic program
over the lengths finds the sum nearest to the budget.  Where the program would not fit into memory every length first gives its
proportional share, and a random core of lengths is fitted to the rest.  Which documents of a length are taken is decided by a
seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .textcore import word_chunks

#: No document is taken more often.
MOST = 3
#: Bits of all sets that the dynamic program holds at once.
WORK = 1 << 30
#: Documents of one source and length are told apart by this many hash buckets before any are ranked.
BUCKETS = 1024
MAX_SOURCES = 1_000_000


def _sizes(batches: Iterable[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for a, b, words in word_chunks(batch, "text", hashes=False):
            sizes[a:b] = words.counts
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes)], names=[*keep, "size"])


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Words that each source should give: sources by code point, null last, weigh ``weights``, repeating, and share all
    words; a source stops at ``most`` times its size and what it can't give is shared by the others' weights."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    out: dict[str | None, float] = {}
    free = list(order)
    while free:
        unit = (total - sum(out.values())) / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in full}
        free = [s for s in free if s not in out]
    return out


def _nearest(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """How many of each length make the sum nearest to budget, of equally near ones the lesser: bounded knapsack in bit sets, whose
    bit i tells whether the sum i can be reached; a count is cut into powers of two."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or budget >= total:
        return take if budget <= 0 else counts.astype(np.int64).copy()
    # the nearest sum above is less than the longest document away
    mask = (1 << (budget + int(lengths.max()) + 1)) - 1
    reach, history = 1, []
    for k in order.tolist():
        left, step = int(counts[k]) if lengths[k] else 0, 1
        while left and not reach >> budget & 1:
            step = min(step, left)
            history.append((k, step, reach))
            reach |= (reach << int(lengths[k]) * step) & mask
            left -= step
            step *= 2
    at, beyond = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1, reach >> (budget + 1)
    if beyond and (above := budget + (beyond & -beyond).bit_length()) - budget < budget - at:
        at = above
    for k, step, before in reversed(history):
        if not before >> at & 1:
            take[k] += step
            at -= int(lengths[k]) * step
    return take


def _bits(lengths: np.ndarray, counts: np.ndarray, budget: int) -> int:
    """Of all bit sets of _nearest."""
    return sum(int(c).bit_length() for c in counts) * (budget + int(lengths.max(initial=0)) + 1)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, rng: np.random.Generator, work: int = WORK) -> np.ndarray:
    """How many documents of each length to take, at most counts, for a sum as near to budget as can be reached.

    The program runs over all lengths where its bit sets fit into ``work``.  Otherwise each length first gives its share and a seeded walk
    tops that up; then a random core of lengths, as many as fit, gives back what it gave and is fitted anew to all that is missing.
    """
    total = int((lengths * counts).sum())
    if 2 * budget > total:
        return counts - fit(lengths, counts, total - budget, rng, work)
    order = rng.permutation(len(lengths))
    if budget <= 0 or _bits(lengths, counts, budget) <= work:
        return _nearest(lengths, counts, budget, order)
    # whole numbers of any size: counts times budgets don't fit 64 bits in a large corpus
    take = (counts.astype(object) * budget // total).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    for k in order.tolist():
        if take[k] < counts[k] and lengths[k] <= rest:
            take[k] += 1
            rest -= int(lengths[k])
    some, missing, sets, longest = [], rest, 0, 0
    for k in rng.permutation(len(lengths)).tolist():  # another order than the walk's, for lengths that gave all and that gave nothing
        more, width = sets + int(counts[k]).bit_length(), max(longest, int(lengths[k]))
        given = missing + int(lengths[k] * take[k])
        if lengths[k] and more * (given + width + 1) <= work:
            some.append(k)
            missing, sets, longest = given, more, width
    core = np.array(some, np.int64)
    if len(core):
        take[core] = _nearest(lengths[core], counts[core], missing, np.arange(len(core)))
    return take


_PLAN = "source string, size long, base long, extra long, count long"


def _plan(key: tuple[pa.Scalar, ...], table: pa.Table, seed: int, most: int) -> pa.Table:
    """How often each length of a source is taken as a whole, and how many of its documents once more."""
    frame = table.to_pandas().sort_values("size")
    lengths, counts = frame["size"].to_numpy(np.int64), frame["count"].to_numpy(np.int64)
    target, total = float(frame["target"].iloc[0]), int((lengths * counts).sum())
    base = min(most, int(target // total)) if total else 0
    name = key[0].as_py()
    rng = np.random.default_rng([seed, *(name or "\0").encode("utf-8", "surrogatepass")])
    budget, n = round(target - base * total), len(lengths)
    extra = fit(lengths, counts, budget, rng) if base < most else np.zeros(n, np.int64)
    if base + 1 < most and (gap := abs(budget - int((lengths * extra).sum()))):
        # where one copy more of some documents doesn't do, some may come more often
        more = fit(lengths, counts * (most - base), budget, rng)
        if abs(budget - int((lengths * more).sum())) < gap:
            extra = more
    return pa.table([pa.array([name] * n, pa.string()), pa.array(lengths), pa.array(base + extra // counts), pa.array(extra % counts), pa.array(counts)], names=["source", "size", "base", "extra", "count"])


def mixed(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    size is the number of ``[^\\x20\\x09-\\x0D]+`` words, 0 for a null text; taken = copies * size and copies <= most.
    Targets are those of ``targets``; null is a source of its own, after all others.  Repeated ids are ranked by a hash of
    source, size and id and may share their fate only if they are equal in all three; a null id counts as an id.
    An empty table gives no rows; a source without words gets target 0.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = stored(rows.mapInArrow(partial(_sizes, keep=("doc_id", "source")), "doc_id long, source string, size long"), "sized")
    lengths = stored(sized.groupBy("source", "size").agg(F.count("*").alias("count")), "lengths")
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    known = {r["source"]: r["source_size"] for r in totals.limit(MAX_SOURCES + 1).collect()}
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = spark.createDataFrame([(s, known[s], t) for s, t in targets(known, weights, most).items()], "source string, source_size long, target double")

    same = lambda a, b, *more: a.source.eqNullSafe(b.source) & (F.lit(True) if not more else a[more[0]] == b[more[0]])
    told = lengths.join(F.broadcast(goals) if len(known) <= 10_000 else goals, same(lengths, goals)).select(lengths.source, "size", "count", "target")
    plan = told.groupBy("source").applyInArrow(lambda key, table: _plan(key, table, seed, most), _PLAN)

    # which documents of a length take one more copy: whole hash buckets first, then ranks within one bucket
    drawn = sized.withColumn("draw", F.xxhash64(F.lit(seed), "source", "size", "doc_id")).withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.lit(BUCKETS)))
    buckets = drawn.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    window = Window.partitionBy("source", "size").orderBy("bucket")
    before = buckets.withColumn("before", F.sum("n").over(window) - F.col("n"))
    quota = before.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.size") == F.col("p.size")))
    quota = stored(quota.select("b.source", "b.size", "bucket", "n", "base", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("extra") - F.col("before"))).alias("more")), "quota")
    each = drawn.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.bucket") == F.col("q.bucket")))
    each = each.select("doc_id", "d.source", "d.size", "draw", "d.bucket", "n", "base", "more")
    whole = each.filter("more = 0 OR more = n").withColumn("copies", F.col("base") + F.when(F.col("more") > 0, 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "doc_id"))
    part = each.filter("more > 0 AND more < n").withColumn("copies", F.col("base") + F.when(rank <= F.col("more"), 1).otherwise(0))
    done = whole.unionByName(part).select("doc_id", "source", "size", F.col("copies").cast("long").alias("copies"))
    out = done.alias("x").join(F.broadcast(goals).alias("g") if len(known) <= 10_000 else goals.alias("g"), F.col("x.source").eqNullSafe(F.col("g.source")))
    return out.select("doc_id", "x.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
