"""The ranked search against a scan of all documents."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import lexical  # noqa: E402

ITEMS = "item_id long, text string, score long, block long, rank int, query long"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=50):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    lengths = [sum(c.values()) for _, c in docs]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        own = set(terms(text))
        found = []
        for (doc, c), length in zip(docs, lengths, strict=True):
            m = 100 - 50 + 50 * length * n // total if total else 0
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -score) for i, (score, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def searched(spark, rows, items, **how):
    df = spark.createDataFrame([(*x, *[None] * 4) for x in items], ITEMS)
    return sorted((tuple(r) for r in lexical.search(frame(spark, rows), df, **how).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus():
    """Words of very different frequency, ties, repeated rows, null ids and a very long text."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    often = [1 / (i + 1) for i in range(300)]
    rows = documents()
    rows += [(5000 + i, ("-" if i % 2 else " ").join(rng.choices(words, often, k=rng.choice((1, 5, 30, 200)))), None, None, None) for i in range(200)]
    rows += [(9000 + i % 3, "W1 w2, w3; w250", None, None, None) for i in range(60)] + [(None, "w1 w2 w3 w250 w250", None, None, None)] * 3
    items = [(i, " ".join(rng.choices(words, often, k=rng.choice((1, 3, 20, 60))))) for i in range(25)]
    items += [(100, "w250 W250 w1"), (100, "w250 w1"), (None, "é ß"), (101, None), (102, ""), (103, "never seen"), (104, "a b c d"), (105, "\x1f.,"), (106, "w1" + " " + " ".join(words))]
    return rows, items


@pytest.mark.parametrize("how", [{}, {"k": 3, "block": 4, "seeds": 1, "item_bytes": 600}])
def test_as_plain(spark, how, monkeypatch):
    rows, items = corpus()
    if how:
        for name in ("SUMS", "FOUND"):
            monkeypatch.setattr(lexical, name, 50)
    assert searched(spark, rows, items, **how) == brute(rows, items, how.get("k", 50))


def test_pruned():
    """Blocks whose bound stays below the threshold aren't scored."""
    import numpy as np

    queries = lexical.Queries([b"a b", b"c"])
    queries.weigh(10, np.array([1, 1, 1]))
    held = np.flatnonzero(queries.owners == 0).astype(np.int32)  # each term has one query
    assert lexical.bounds(queries, held, np.array([5, 7])).tolist() == [(5 + 7) * queries.weights[0], 0.0]
    best = lexical.Best(2, 2, np.array([3, 1]))
    best.add(np.array([0, 0, 0, 0, 1]), np.array([9, 8, 7, lexical.NULL_ID, 5]), np.array([2, 4, 4, 4, 1]))
    query, doc, score = best.settle()
    assert query.tolist() == [0, 0, 1] and doc.tolist() == [7, 8, 5] and score.tolist() == [4, 4, 1] and best.least.tolist() == [4, 1]


def test_no_rows(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a", None, None, None)], []) == []
    assert searched(spark, [(1, None, None, None, None), (2, " . ", None, None, None)], [(1, "a")]) == []
