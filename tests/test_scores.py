"""Edge scores on graphs whose values are worked out by hand."""

import math

import pytest

from thicket.operators import degrees, edges as E
from thicket.sources import fixtures


def scores(df):
    return {(r.src, r.dst): r.score for r in degrees.scored(df).collect()}


# Graphs and their scores, worked out by hand.
@pytest.mark.parametrize(
    "pairs,expected",
    [
        ([(0, 1), (1, 2), (0, 2)], {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 1.0}),
        ([(0, 1), (1, 2)], {(0, 1): 1.5, (1, 2): 1.5}),
        ([(0, 1), (0, 2), (0, 3)], {(0, 1): 4 / 3, (0, 2): 4 / 3, (0, 3): 4 / 3}),
        ([(0, 1), (1, 2), (2, 3)], {(0, 1): 1.5, (1, 2): 1.0, (2, 3): 1.5}),
    ],
)
def test_small(spark, pairs, expected):
    got = scores(fixtures.edges_of(spark, pairs))
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=1e-12) for k in expected)


def test_scores_sum_to_the_number_of_nodes(spark):
    edges, _ = fixtures.karate(spark)
    s = degrees.score_summary(edges).first()
    assert s.m == 78 and math.isclose(s.total, 34.0)
    assert degrees.graph_size(edges) == (34, 78)
    p = degrees.normalized(edges).agg({"p": "sum", "w": "sum"}).first()
    assert math.isclose(p["sum(p)"], 1.0) and math.isclose(p["sum(w)"], 78.0)


def test_degrees_keep_isolated_nodes(spark):
    got = {r.id: r.d for r in degrees.degrees(fixtures.edges_of(spark, [(0, 1)]), spark.range(3)).collect()}
    assert got == {0: 1, 1: 1, 2: 0}


def test_canonical(spark):
    raw = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1), (None, 1)], "src long, dst long")
    assert {tuple(r) for r in E.canonical(raw).collect()} == {(1, 2), (1, 4)}
    counts = E.raw_counts(raw.dropna()).first()
    assert (counts.raw_rows, counts.self_loops, counts.edges, counts.multi_edges_collapsed) == (4, 1, 2, 1)
    E.require_canonical(E.canonical(raw))
    with pytest.raises(ValueError):
        E.require_canonical(raw)


def test_dense_ids(spark):
    ids = E.dense_ids(spark.createDataFrame([(30,), (10,), (20,)], "id long"))
    assert {r.id: r.new_id for r in ids.collect()} == {10: 0, 20: 1, 30: 2}


def test_trials_derive_the_graph_once(spark):
    """Trials over a graph that is joined and made distinct on the way read it as stored, and join it once for either end."""
    from thicket.plans import experiments

    edges = spark.range(60).selectExpr("id % 6 AS src", "6 + id % 7 AS dst").distinct()
    labels = spark.range(13).selectExpr("id", "id % 2 AS comm")
    trials = experiments.sampled_trials(edges, labels, (0.3, 1.0), (1, 2))
    plan = trials._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4 and "% 7" not in plan
    rows = {(r.alpha, r.seed): r for r in trials.collect()}
    assert all(r.m == 42 and r.m_sparse == r.intra + r.inter for r in rows.values())
    assert all(abs(r.df - (r.intra / r.m_sparse - 21 / 42)) < 1e-12 for r in rows.values())


def test_trials_count_degrees_once(spark, monkeypatch):
    """Degrees are summed up in one pass over the edges, for the graph's size and for the scores."""
    from thicket.operators import degrees, statistics
    from thicket.plans import experiments

    passes, count = [], degrees.degrees
    for module in (degrees, statistics, experiments):
        monkeypatch.setattr(module, "degrees", lambda *a, **k: passes.append(a) or count(*a, **k), raising=False)
    edges = spark.range(60).selectExpr("id % 6 AS src", "6 + id % 7 AS dst").distinct()
    rows = experiments.sampled_trials(edges, spark.range(13).selectExpr("id", "id % 2 AS comm"), (0.3, 1.0), (1, 2)).collect()
    assert len(passes) == 1 and all(r.m == 42 for r in rows)


def test_edges_that_are_scored_stay(spark):
    """Samplers take scores that are there already, and give the same edges."""
    from thicket.operators import degrees, sparsify as S
    from thicket.storage import stored

    edges = stored(spark.range(60).selectExpr("id % 6 AS src", "6 + id % 7 AS dst").distinct().filter("src + dst < 16"))
    rated = stored(degrees.scored(edges))
    assert "Join" not in degrees.scored(rated)._jdf.queryExecution().optimizedPlan().toString()
    for method in ("paper", "probabilistic_no_replace", "deterministic", "uniform_random", "degree_sampling"):
        assert sorted(map(tuple, S.sparsify(rated, method, 0.5, 1).collect())) == sorted(map(tuple, S.sparsify(edges, method, 0.5, 1).collect()))


def test_parts_of_an_order_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """The tasks that join and tell pairs apart grow in number with the table."""
    from thicket.functions import ordered
    from thicket.sources import derived

    spark.range(300).selectExpr("id div 3 AS l_orderkey", "id % 50 AS l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(ordered, "ROWS", 100)
    found = derived.parts_together(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 24
    assert found.count() == len({(min(a, b), max(a, b)) for o in range(100) for a in (3 * o % 50, (3 * o + 1) % 50, (3 * o + 2) % 50) for b in (3 * o % 50, (3 * o + 1) % 50, (3 * o + 2) % 50) if a != b})


def test_a_file_is_read_once(spark, tmp_path):
    """Edges and ids come from the distinct pairs as stored, not each from the file."""
    from thicket.sources import files

    (tmp_path / "g.txt").write_text("1 2\n2 1\n7 7\n2 9\n")
    edges, ids = files.read_snap(spark, str(tmp_path / "g.txt"))
    assert "g.txt" not in "".join(edges.inputFiles()) + "".join(ids.inputFiles())
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 3)] and {r.id: r.new_id for r in ids.collect()} == {1: 0, 2: 1, 7: 2, 9: 3}
