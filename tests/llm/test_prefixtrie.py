"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from thicket.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, name string, size long, kind int, parent string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_heads(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = {}, {}
    for c, turns in convs:
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), children.get(x, 0), leaves[x], saved[x], sha(ends.get(x, []))) for x, m in members.items())


def conversations(seed=4):
    """Shared turns, copies, one first turn for a third of all, ties, nulls, very long conversations and texts, clashing columns."""
    rng = random.Random(seed)
    texts = ["", "hi", "é", "a\nb", "Ω" * 50, "user"]
    rows = []
    for c in [*range(60), *range(100, 230), 1000, -5, -107]:
        base = rng.randrange(4)
        for t in range(rng.choice((1, 2, 2, 3, 4, 8))):
            shared = rng.random() < 0.8
            rows.append((c, t, ("user", "assistant", None)[t % 2 if rng.random() < 0.95 else 2], "hello" if c % 3 == 0 and t == 0 else texts[(base + t) % 6] if shared else f"{c}-{t}" * rng.randint(1, 5)))
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(7)]
    rows += [(500, t, "user", f"long {t % 3}") for t in range(700)] + [(501, t, "user", f"long {t % 3}") for t in range(650)]
    rows += [(7, None, "user", "no turn"), (7, None, None, None), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "user", "a tie"), (None, 1, "user", "nobody"), (9, 3, "user", "x" * 100_000), (400, 0, "usera", "b"), (401, 0, "user", "ab")]
    return rows


def trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in prefixtrie.prefix_trie(prefixtrie.shared_heads(df), **how).select(*COLUMNS).collect())


@pytest.mark.parametrize("how", [{}, {"run_bytes": 3000, "range_bytes": 2000}, {"run_bytes": 1, "range_bytes": 300}])
def test_as_plain(spark, how):
    """With ranges of a few sequences most nodes span ranges."""
    rows = conversations()
    assert trie(spark, rows, **how) == plain_trie(plain_heads(rows).items())


def test_copies_and_turnless(spark, monkeypatch):
    """Repeated ids, many members of one node in pieces, and conversations without turns."""
    monkeypatch.setattr(prefixtrie, "PIECE", 5)
    turn = lambda *texts: [("user", t) for t in texts]
    convs = [(i, turn("a", "b")) for i in range(50)] + [(3, turn("a", "b")), (60, []), (61, []), (-2, turn("a")), (5, turn("c", "a", "b"))]
    data = [(c, [(hashlib.md5(t.encode()).hexdigest(), len(t)) for _, t in turns]) for c, turns in convs]
    df = spark.createDataFrame(data, "conv_id long, turns array<struct<digest: string, size: long>>")
    assert sorted(tuple(r) for r in prefixtrie.prefix_trie(df).select(*COLUMNS).collect()) == plain_trie(convs)


def test_no_rows(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


def test_merge():
    """The loser tree gives any pieces in order, with the turns shared with the sequence before."""
    rng = random.Random(2)
    import numpy as np

    for k in (1, 2, 3, 7, 16):
        keys = sorted({b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(150 if rng.random() < 0.1 else 9))) for _ in range(200)})
        dealt = [[x for x in keys if hash(x) % k == i] for i in range(k)]
        streams = []
        for some in dealt:
            lcps = [0] + [prefixtrie.common(a, b) for a, b in zip(some, some[1:], strict=False)]
            tail = [x[16 * n :] for x, n in zip(some, lcps, strict=False)]
            row = {"lcps": lcps[: len(some)], "depths": [len(x) // 16 for x in some], "counts": [1] * len(some), "leasts": [0] * len(some), "sizes": [0] * (sum(map(len, tail)) // 16)}
            streams.append(prefixtrie.Stream({c: np.array(v, np.int64).tobytes() for c, v in row.items()} | {"names": b"\0" * 16 * len(some), "turns": b"".join(tail)}))
        got = [(s.key, s.lcp) for s in prefixtrie.merged(streams)]
        assert [x for x, _ in got] == keys
        assert [n for _, n in got[1:]] == [prefixtrie.common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
