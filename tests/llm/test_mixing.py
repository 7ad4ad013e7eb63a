import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import mixing  # noqa: E402


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    # c stops at 3 * 10, the rest goes to a and b by 1 to 2
    t = mixing.targets({"a": 100, "b": 100, "c": 10})
    assert t == {"a": 60.0, "b": 120.0, "c": 30.0}
    assert mixing.targets({}) == {} and mixing.targets({None: 5}) == {None: 5.0}
    assert list(mixing.targets({None: 10, "b": 10, "a": 10}).items()) and mixing.targets({None: 10, "b": 10, "a": 10})[None] == 15.0


def miss(lengths, counts, budget, **how):
    """How far fit misses the budget, and how far the nearest sum of all does."""
    take = mixing.fit(lengths, counts, budget, np.random.default_rng(1), **how)
    assert ((take >= 0) & (take <= counts)).all()
    reach = 1
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        for _ in range(c):
            reach |= reach << n
    near = next(d for d in range(budget + int(lengths.max()) + 2) if (d <= budget and reach >> (budget - d) & 1) or reach >> (budget + d) & 1)
    return abs(int((lengths * take).sum()) - budget), near


@pytest.mark.parametrize("seed", range(12))
def test_fit_is_as_near_as_can_be(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 60, 6))
    counts = rng.integers(1, 4, len(lengths))
    got, near = miss(lengths, counts, int(rng.integers(0, int((lengths * counts).sum()) + 1)))
    assert got == near


@pytest.mark.parametrize("seed", range(6))
def test_long_documents(seed):
    """Few long documents, and several of a length: the nearest sum of all."""
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(40_000, 90_000, 20 if seed % 2 else 7))
    counts = np.ones(len(lengths), np.int64) if seed % 2 else rng.integers(1, 5, len(lengths))
    for share in (0.5, 0.13, 0.9):
        got, near = miss(lengths, counts, int(share * int((lengths * counts).sum())))
        assert got == near


def test_core():
    """With little memory a core of the lengths is fitted: many documents still meet the budget."""
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(3000, 9000, 400))
    counts = np.ones(len(lengths), np.int64)
    for share in (0.3, 0.5, 0.71):
        got, near = miss(lengths, counts, int(share * int(lengths.sum())), work=1 << 24)
        assert got <= 2 and near == 0


def test_large_budgets_are_met():
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(1, 5000, 900))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.1, 0.37, 0.9):
        budget = int(total * share)
        assert int((lengths * mixing.fit(lengths, counts, budget, np.random.default_rng(2))).sum()) == budget


def test_mix(spark):
    rows = documents()
    got = mixing.mixed(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((r[0], count(r[1])) for r in rows if r[0] is not None)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    want = mixing.targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == want[r.source]
    for s in sizes:
        lengths = sorted((r.size for r in got if r.source == s), reverse=True)
        # one document has 20000 words: the nearest sum of up to three copies each
        reach = 1
        for n in lengths:
            for _ in range(3):
                reach |= reach << n
        near = min((abs(x - want[s]) for x in range(max(0, int(want[s]) - 20001), int(want[s]) + 20002) if reach >> x & 1), default=0)
        assert abs(taken[s] - want[s]) <= near + 1, (s, taken[s], want[s])
    again = mixing.mixed(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert mixing.mixed(frame(spark, [])).collect() == []
    row = mixing.mixed(frame(spark, [(1, None, None, None, None)])).first()
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)
