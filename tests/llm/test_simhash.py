"""The trie self-join against a comparison of all fingerprints."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import simhash  # noqa: E402


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    """The least place that each print reaches."""
    prints = np.array(prints, np.uint64)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= bits).tolist():
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def brute(rows):
    prints = [plain_print(r[1]) for r in rows]
    least = {}
    for r, c in zip(rows, component := components(prints), strict=True):
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    return sorted(((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, component, strict=True)), key=str)


def joined(df, **how):
    return sorted((tuple(r) for r in simhash.simhash_components(df, **how).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def crowded(seed, n, balls, flips=9):
    """Prints in dense balls, in chains and alone, with many at and around the distance that links."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    centres = [rng.getrandbits(64) for _ in range(balls)]
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
        if rng.random() < 0.05:
            for _ in range(5):
                for _ in range(3):
                    x ^= 1 << rng.randrange(64)
                out.add(x)
    return sorted(out)


def test_fingerprints(monkeypatch):
    texts = [r[1] for r in documents()] + ["A b\x0bC\x1cd é", "ab", "a b", "É É É É", "x " * 5000 + "end"]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [plain_print(t) for t in texts]
    # pieces of any size give the same words
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 7)
    monkeypatch.setattr(simhash, "SUMMED", 3)
    assert [simhash.fingerprint((t or "").encode()) for t in texts if len(t or "") < 3000] == [plain_print(t) for t in texts if len(t or "") < 3000]


@pytest.mark.parametrize("seed,n,balls,bits", [(1, 700, 4, 3), (2, 1500, 1, 3), (3, 900, 60, 3), (4, 600, 3, 1), (5, 600, 3, 4), (6, 500, 2, 0)])
def test_walk(seed, n, balls, bits):
    """Both walks of the whole trie as one node pair find every component."""
    prints = np.array(crowded(seed, n, balls), np.uint64)
    half = np.uint64(32)
    turned = np.sort(prints << half | prints >> half)
    links = [(prints[i], prints[j]) for i, j in simhash.walk(prints, prints, True, 0, 0, bits)]
    links += [(turned[i] << half | turned[i] >> half, turned[j] << half | turned[j] >> half) for i, j in simhash.walk(turned, turned, True, 0, 0, bits)]
    assert len(links) <= 2 * n and all(int(u ^ v).bit_count() <= bits for u, v in links)
    place = {int(x): i for i, x in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in links:
        x, y = find(place[int(u)]), find(place[int(v)])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == components(prints, bits)


@pytest.mark.parametrize("leaf,levels,balls", [(8, 8, 2), (1, 3, 40)])
def test_dealt(spark, leaf, levels, balls):
    """Tiny nodes, so that hot ones are expanded in DataFrames down to the last bits: no link may be lost."""
    from thicket.graph.components import component_labels

    prints = crowded(11 + leaf, 350, balls, 5)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "print long"), len(prints), 3, leaf, levels)
    got = {r["id"]: r["component"] for r in component_labels(links).collect()}
    expected = components(prints)
    members = {}
    for x, c in zip(signed, expected, strict=True):
        members.setdefault(c, []).append(x)
    assert {x: got.get(x, x) for x in signed} == {x: min(members[c]) for x, c in zip(signed, expected, strict=True)}


def test_small_corpus(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows and columns of clashing names."""
    rows = documents()
    assert joined(frame(spark, rows)) == brute(rows)
    assert joined(frame(spark, rows), leaf=16) == brute(rows)


def test_copies_and_empty_texts(spark):
    """Many copies of one text, many texts without words and many rows without an id."""
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(1000 - i, words, None, None, None) for i in range(90)] + [(i, (None, "", " \n")[i % 3], None, None, None) for i in range(90)]
    rows += [(None, words, None, None, None)] * 70 + [(None, "one lone text here", None, None, None), (7, words + " more", None, None, None)]
    assert joined(frame(spark, rows)) == brute(rows)


def test_no_rows(spark):
    assert joined(frame(spark, [])) == []
    assert joined(frame(spark, [(1, None, None, None, None)])) == [(1, "0" * 16, 1)]
