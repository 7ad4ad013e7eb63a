"""The set join against a comparison of all pairs."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import setjoin  # noqa: E402


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(ids[find(i)]) if find(i) in ids else None) for i in range(len(rows))), key=str)


def joined(df, **how):
    return sorted((tuple(r) for r in setjoin.jaccard_components(df, **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_small_corpus(spark):
    rows = documents()
    assert joined(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("cell,pivots,hot", [(4, 1, 3), (64, 16, 2), (1, 2, 1000)])
def test_hard_families(spark, cell, pivots, hot):
    """Many near copies around the threshold, with cells, pivots and hot tokens set small: no link may be lost."""
    rng = random.Random(7)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(50)]
        for _ in range(45):
            t = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
                t[rng.randrange(50)] = f"x{rng.randrange(6)}"
            rows.append((len(rows), " ".join(t), None, None, None))
    assert joined(frame(spark, rows), cell=cell, pivots=pivots, hot=hot) == brute(rows)


def test_many_copies(spark):
    """More copies of one text, and more empty texts, than one task should take; a near copy links with the copies."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1000 - i, words, None, None, None) for i in range(90)] + [(i, (None, "", " ")[i % 3], None, None, None) for i in range(90)]
    rows += [(5000, words + " more", None, None, None), (None, words, None, None, None), (6000, "a lone text", None, None, None)]
    assert joined(frame(spark, rows)) == brute(rows)


def test_rows_without_ids(spark, monkeypatch):
    """Near copies of which hundreds have no id, or all the same one: each text is read once, not once for each row."""
    rng = random.Random(9)
    rows = []
    for k in range(250):
        base = [f"t{k}w{i}" for i in range(30)]
        more = list(base)
        more[rng.randrange(30)] = "other"
        key = None if k < 125 else 77
        rows += [(key, " ".join(base), None, None, None), (key, " ".join([*base, "end"]), None, None, None), (key if k % 2 else k, " ".join(more), None, None, None)]
    read = []
    counted = setjoin.stored

    def stored(df, name="t"):
        out = counted(df, name)
        if name == "sets":
            read.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "stored", stored)
    assert joined(frame(spark, rows)) == brute(rows)
    assert read[0] <= len(rows)


def test_buckets(spark, monkeypatch):
    """Buckets grow with the input beyond the shuffle partitions."""
    from thicket.llm import exchange

    known, n = spark.range(1 << 20), exchange.partitions(spark)
    assert exchange.buckets_for(known) == n and exchange.buckets_for(frame(spark)) == n * exchange.UNKNOWN
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 1 << 20)
    assert exchange.buckets_for(known) == 3 * n


def test_empty(spark):
    assert joined(frame(spark, [])) == []
    assert joined(frame(spark, [(1, None, None, None, None), (2, "", None, None, None)])) == [(1, 0, 1), (2, 0, 2)]
