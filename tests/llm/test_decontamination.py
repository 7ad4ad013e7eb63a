import random
import sys
from collections import Counter
from math import log
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import decontamination as D  # noqa: E402


def words(text):
    return D.plain((text or "").encode()).lower().split()


def brute(docs, items):
    """Best similarity of every item to any window of its length, by plain loops over words."""
    bags = {}
    for i, t in items:
        w = words(t)
        if len(w) >= 5:
            bags[i] = (len(w), Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    held = Counter(s for _, b in bags.values() for s in b)
    weight = lambda s: max(1, round(64 * log(1 + len(bags) / held[s]) / log(1 + len(bags)))) if s in held else 64
    out = set()
    for d, t in docs:
        w = words(t)
        for i, (n, bag) in bags.items():
            best = 0.0
            for a in range(max(1, len(w) - n + 1)):
                own = Counter(tuple(w[k : k + 5]) for k in range(a, min(a + n, len(w)) - 4))
                if own:
                    top = sum(weight(s) * min(c, own[s]) for s, c in bag.items())
                    best = max(best, top / (sum(weight(s) * c for s, c in own.items()) + sum(weight(s) * c for s, c in bag.items()) - top))
            if best >= 0.8:
                out.add((d, i, round(best, 9)))
        out |= {(d, i, 1.0) for i, u in items if 0 < len(words(u)) < 5 and words(u) == w}
    return out


def test_against_all_windows(spark):
    rng = random.Random(4)
    pool = [f"b{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice((5, 12, 30, 45))))) for i in range(20)] + [(50, "one"), (51, "a b c d"), (52, "")]
    items.append((53, " ".join(items[3][1].split()[:12] + items[7][1].split())))
    docs = [(r[0], r[1]) for r in documents() if r[0] is not None]  # a very long text among them
    docs.append((1999, " ".join(" ".join(items[rng.randrange(20)][1].split()) + " " + rng.choice(pool) for _ in range(60))))
    for k in range(40):
        w = [rng.choice(pool) for _ in range(80)]
        own = rng.choice(items[:20])[1].split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            own[rng.randrange(len(own))] = rng.choice(pool)
        at = rng.randrange(len(w))
        text = w[:at] + own + w[at:]
        docs.append((2000 + k, " ".join(x.upper() + "," if rng.random() < 0.2 else x for x in text)))
    bench = spark.createDataFrame([*items, (None, "x y z"), (60, None)], "item_id long, text string")
    df = frame(spark, [(*d, None, None, None) for d in docs])
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in D.contaminated(df, bench).collect()}
    assert got == brute(docs, items) and len(got) > 20
    left = D.decontaminated(df, bench)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in {x[0] for x in got})


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 999, 20)).encode()) for i in range(50)]
    index = D.Index(items)
    for _ in range(200):
        j = int(rng.integers(50))
        flips = rng.choice(64, int(rng.integers(0, index.radius + 1)), replace=False)
        asked = index.prints[j] ^ np.bitwise_or.reduce(np.append(np.uint64(1) << flips.astype(np.uint64), np.uint64(0)))
        found = np.concatenate([j for _, j in index.candidates(20, np.array([asked], np.uint64))])
        every = [k for k in range(50) if int(index.prints[k] ^ asked).bit_count() <= index.radius]
        assert j in found and sorted(found.tolist()) == every


def test_many_short_items(monkeypatch):
    """A leaked benchmark of short items of one length: found by their very fingerprints, whatever their number."""
    import time

    rng = random.Random(1)
    items = [(i, f"q{i} " + " ".join(f"w{rng.randrange(900)}" for _ in range(5))) for i in range(20_000)]
    index = D.Index([(i, t.encode()) for i, t in items])
    assert not len(index.of_length[6]) and len(index.same_of[6]) == 20_000
    began = time.thread_time()
    found = next(index.scan([" and ".join(t for _, t in items[:4000]).encode()]))
    assert sorted(x[0] for x in found) == list(range(4000)) and all(x[1] == 1.0 for x in found)
    assert time.thread_time() - began < 20


def test_bounds_lose_nothing(monkeypatch):
    """Pieces of any size and a bound that can't tell give the same findings."""
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice((7, 25))))) for i in range(40)]
    index = D.Index([(i, t.encode()) for i, t in items])
    text = " ".join(" ".join(t.split()[: len(t.split()) - rng.randrange(3)]) + f" x{k}" for k, (_, t) in enumerate(items)).encode()
    found = list(index.scan([text]))
    assert len(found[0]) > 20
    for name, value in (("PAIRS", 7), ("FEW", 0), ("PLACES", 0), ("FEW", 1 << 30)):
        monkeypatch.setattr(D, name, value)
        assert list(index.scan([text])) == found


def test_empty(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(frame(spark, []), bench).collect() == []
    assert D.contaminated(frame(spark), bench.limit(0)).collect() == []
    assert D.decontaminated(frame(spark), bench.limit(0)).count() == len(documents())
