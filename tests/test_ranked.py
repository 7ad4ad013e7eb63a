"""The first k rows by counting, and joins on frequent keys."""

import random

import pytest

from thicket.functions import ranked
from thicket.operators import sparsify as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = [(rng.choice((0.25, 0.5, rng.random(), -1e300, 1e300, 3e-320)), rng.randrange(-5, 5), i) for i in range(400)]
    return out, spark.createDataFrame(out, "x double, y long, i long").cache()


@pytest.mark.parametrize("bins,few", [(4096, 10_000), (3, 5), (2, 0)])
def test_first_k(rows, bins, few):
    plain, df = rows
    for k in (0, 1, 57, 200, 399, 400, 900):
        got = {tuple(r) for r in ranked.first_k(df, ["x", "y", "i"], k, bins, few).collect()}
        assert got == set(sorted(plain)[:k])


def test_whole_numbers(spark):
    df = spark.range(1000).selectExpr("id * 1152921504606846 AS h", "id")
    assert ranked.first_k(df, ["h"], 123, 7, 2).count() == 123
    assert ranked.kth(df.filter("id < 0"), ["h"], 1) is None


def test_keyed_join(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 90 else i) for i in range(100)], "x long, k long")
    table = spark.createDataFrame([(g, 30 if g < 3 else 1, g * 10) for g in [0, 1, 2, *range(90, 98)]], "k long, count long, y long")
    for least in (1, 10, 100):
        got = sorted(tuple(r) for r in ranked.keyed_join(df, table, "k", 100, ["x"], least).collect())
        assert got == sorted((i, g, 30 if g < 3 else 1, g * 10) for i in range(98) for g in [i % 3 if i < 90 else i])
        got = {tuple(r)[:3] for r in ranked.keyed_join(df, table, "k", 100, ["x"], least, "left").collect()}
        assert got == {(i, g, 30 if g < 3 else 1 if g < 98 else None) for i in range(100) for g in [i % 3 if i < 90 else i]}


def test_plans_have_no_single_task(spark):
    from thicket.sources import fixtures

    edges = fixtures.karate(spark)[0]
    for df in (S.top_k(edges, 0.5), S.uniform(edges, 0.5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_epsilon():
    assert S.epsilon_of(0.4) == 1.5 and abs(S.epsilon_of(0.5) - 1.15) < 1e-12 and S.epsilon_of(0.1) == 3.0
    for alpha in (0, -1, 1.1):
        with pytest.raises(ValueError):
            S.epsilon_of(alpha)
