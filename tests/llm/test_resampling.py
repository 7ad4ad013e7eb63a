import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import resampling  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    good, bad = [f"fine{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    both = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice((bad if i % 4 == 0 else good) if rng.random() < 0.4 else both) for _ in range(60)), None, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 200)], LABELS)
    got = {r.doc_id: r.kept for r in resampling.resampled(frame(spark, rows), labels).collect()}
    held = range(200, 400)
    assert sum(got[i] == (i % 4 != 0) for i in held) >= 196
    again = {r.doc_id: r.kept for r in resampling.resampled(frame(spark, rows).repartition(2), labels).collect()}
    assert got == again
    kept = resampling.kept_documents(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i]}


def test_odd_rows(spark):
    rows = documents()
    df = frame(spark, rows)
    none = spark.createDataFrame([], LABELS)
    got = resampling.resampled(df, none).collect()
    assert len(got) == len(rows) and all(r.kept for r in got)
    some = spark.createDataFrame([(3, 1, None), (6, 0, 0), (None, 1, 0), (9, None, 0), (3, 1, 0), (12, 1, 1), (15, 1, 0)], LABELS)
    assert resampling.resampled(df, some).count() == len(rows)
    assert resampling.kept_documents(df, some).filter("doc_id IS NULL").count() == 2
    assert resampling.resampled(frame(spark, []), some).collect() == []


def test_as_plain(spark):
    """Weights by dictionaries of n-grams, and the documents kept as the k largest keys of a sorted list."""
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice("abcdefghij") * (1 + (i % 3 == 0)) for _ in range(rng.randint(0, 40))), None, None, None) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i == 6)) for i in range(0, 100)], LABELS)
    from pyspark.sql import functions as F

    fit = {r.doc_id: r.fit for r in spark.range(150).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)) == 0).alias("fit")).collect()}
    bins = lambda gram: int(resampling.Words([" ".join(gram).encode()]).hashes[0] >> np.uint64(64 - resampling.BITS)) if len(gram) == 1 else int(resampling.Words([" ".join(gram).encode()]).windows(2)[0] >> np.uint64(64 - resampling.BITS))
    grams = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        grams[i] = [bins(g) for g in [(x,) for x in w] + list(zip(w, w[1:]))]
    raw, target = {}, {}
    for i, own in grams.items():
        for b in own:
            raw[b] = raw.get(b, 0) + 1
            if i < 100 and i % 3 == 0 and i != 6 and fit[i]:
                target[b] = target.get(b, 0) + 1
    share, s = sum(target.values()) / sum(raw.values()), resampling.SMOOTHING
    weight = {i: resampling.LENGTH * sum(np.log((target.get(b, 0) + s) / (raw[b] * share + s)) for b in own) / max(1, len(own)) for i, own in grams.items()}
    got = {r.doc_id: r for r in resampling.resampled(frame(spark, rows), labels).collect()}
    assert all(abs(got[i].log_weight - weight[i]) < 1e-5 and got[i].n_grams == len(grams[i]) for i in grams)
    held = [i for i in range(100) if not fit[i] and i != 6]
    cut = resampling.threshold(np.array([weight[i] for i in held]), np.array([i % 3 == 0 for i in held]))
    k = sum(w >= cut for w in weight.values())
    assert {i for i in got if got[i].kept} == set(sorted(got, key=lambda i: -got[i].key)[:k]) and 0 < k < 150


def test_threshold():
    w, g = np.array([1.0, 2.0, 3.0, 4.0]), np.array([False, False, True, True])
    assert resampling.threshold(w, g) == 2.5
    assert resampling.threshold(w, g | True) == float("-inf") and resampling.threshold(w[:0], g[:0]) == float("-inf")
