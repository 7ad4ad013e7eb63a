"""Samplers: invariants, exact counts, seeds and errors."""

import math

import pytest
from pyspark.sql import functions as F

from thicket.graph.generators import preferential
from thicket.operators import degrees, sparsify as S
from thicket.sources import fixtures


@pytest.fixture(scope="module")
def karate(spark):
    return fixtures.karate(spark)[0].cache()


def pairs(df):
    return {(r.src, r.dst) for r in df.select("src", "dst").collect()}


@pytest.mark.parametrize("method", ["paper", "probabilistic_no_replace", "deterministic", "uniform_random", "degree_sampling"])
def test_subset(karate, method):
    got = S.sparsify(karate, method, 0.5).collect()
    found = [(r.src, r.dst) for r in got]
    assert len(found) == len(set(found)) and set(found) <= pairs(karate)
    assert all(r.src < r.dst and r.weight > 0 for r in got)
    assert pairs(S.sparsify(karate, method, 0.5)) == set(found)


@pytest.mark.parametrize("alpha", [0.25, 0.5, 0.75, 0.9])
def test_top_k(karate, alpha):
    ranked = sorted((-r.score, r.src, r.dst) for r in degrees.scored(karate).collect())
    assert pairs(S.top_k(karate, alpha)) == {(a, b) for _, a, b in ranked[: math.ceil(alpha * 78)]}


def test_top_k_exact(spark):
    edges = fixtures.edges_of(spark, [(0, 1), (0, 2), (1, 2), (1, 4), (3, 4)])
    assert pairs(S.top_k(edges, 0.4)) == {(3, 4), (0, 2)}
    assert S.top_k(fixtures.complete(spark, 50), 0.1).count() == 123


@pytest.mark.parametrize("alpha", [0, -0.5, 1.5])
def test_retention(karate, alpha):
    with pytest.raises(ValueError):
        S.top_k(karate, alpha)


def test_unknown(karate):
    with pytest.raises(ValueError):
        S.sparsify(karate, "nonsense", 0.5)


def test_with_replacement(karate):
    q = math.ceil(0.75 * 78)
    p = {(r.src, r.dst): r.p for r in degrees.normalized(karate).collect()}
    totals = []
    for seed in range(6):
        rows = S.with_replacement(karate, 0.75, seed).collect()
        assert sum(r.k for r in rows) == q and len(rows) <= q
        assert math.isclose(sum(r.weight * p[r.src, r.dst] for r in rows), 1.0)
        totals.append(sum(r.weight for r in rows))
    assert 0.8 * 78 <= sum(totals) / len(totals) <= 1.2 * 78
    assert len(set(totals)) > 1


def test_bernoulli_count(karate):
    counts = [S.bernoulli(karate, 0.5, seed).count() for seed in range(8)]
    assert 0.8 * 39 <= sum(counts) / len(counts) <= 1.2 * 39


def test_uniform_is_exact(spark):
    edges = preferential(spark, 60, 3)
    assert edges.count() == 171
    assert S.uniform(edges, 0.3).count() == math.ceil(0.3 * 171)
    assert S.uniform_count(edges, 1000).count() == 171


def test_full_retention(karate):
    assert S.sparsify(karate, "deterministic", 1.0).count() == 78
    assert 39 < S.sparsify(karate, "paper", 1.0).count() < 78


def test_survival(spark):
    edges, labels = fixtures.barbell(spark, 10)
    row = S.survival_curve(edges, edges.filter("src = 9 AND dst = 10"), [0.5], [1, 2, 3]).first()
    assert math.isclose(row.p_bridge, 0.5 * 0.2 / (20 / 91), rel_tol=1e-9)
    assert row.ratio < 1
    assert edges.agg(F.count("*")).first()[0] == 91
