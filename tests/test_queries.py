"""Every registered graph query against its SQL, on the smallest tables."""

import math
import os

import pytest

from thicket.plans import catalog, experiments

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=str)
    assert a == b


def test_trials(spark):
    from thicket.sources import fixtures

    edges, labels = fixtures.karate(spark)
    row = experiments.theory_trial(edges, labels, 0.5, 1)
    assert row["m"] == 78 and row["epsilon"] < 1e-10
    base = experiments.detected(edges, small=True)
    found = experiments.scaling_trial(edges, base, 1.0, "deterministic", 0.6, 1, "karate", small=True)
    assert found["m_sparse"] == 47 and found["speedup"] > 0
    found = experiments.recovery_trial(edges, labels, base, 0.8, 1, "karate", small=True)
    assert 0 <= found["nmi_sparse"] <= 1
    assert experiments.community_trial(edges, labels, 0.5, 3)["epsilon"] < 1e-10
    assert experiments.citation_row(edges, base, "uniform_random", 0.5, 1, small=True)["edges"] == 39
    grid = experiments.run_grid(lambda a: {"alpha": a, "budget": __import__("thicket.operators.sparsify").operators.sparsify.budget(a, 10)}, [(0.5,), (2.0,)], spark)
    assert grid.count() == 1


def test_toys(spark):
    rows = {r.graph: r for r in experiments.toy_suite(spark).collect()}
    assert abs(rows["barbell"].delta - 0.02) < 1e-12 and abs(rows["grid"].delta - 0.025) < 1e-12


def test_time_limit(spark):
    from thicket.plans import policy

    assert policy.spectral_limit(None) == 300 and policy.spectral_limit(1.0) == 30 and policy.spectral_limit(7.55) == 75
    assert policy.limited(spark, 60, lambda: spark.range(5).count()) == 5
    assert policy.limited(spark, 1.0, lambda: spark.range(1 << 40).selectExpr("sum(hash(id))").collect()) is None
    with pytest.raises(ZeroDivisionError):
        policy.limited(spark, 60, lambda: 1 / 0)


def test_whole_trade_graph(spark):
    """Components, resistances and CPM communities take in every edge and node of the derived graph."""
    from thicket.sources import derived

    edges = [(r.src, r.dst) for r in derived.trade(spark, DATA).collect()]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    parts = {x: top(x) for x in root}
    run = lambda name: catalog.queries()[name](spark, DATA).collect()
    assert {r.id: r.component for r in run("connected_components")} == parts
    sizes = {c: list(parts.values()).count(c) for c in set(parts.values())}
    most = min(sizes, key=lambda c: (-sizes[c], c))
    assert {r.id for r in run("largest_component")} == {x for x, c in parts.items() if c == most}
    found = run("trade_resistance")
    assert sorted((r.src, r.dst) for r in found) == sorted(edges)
    # resistances of all edges add up to nodes less components
    assert abs(sum(r.resistance for r in found) / (len(parts) - len(sizes)) - 1) < 0.1
    comm = {r.id: r.comm for r in run("trade_cpm")}
    assert set(comm) == set(parts) and 1 < len(set(comm.values())) < len(parts)
