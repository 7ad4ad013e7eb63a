"""Community statistics against published and hand-worked values."""

import math

import pytest

from thicket.operators import agreement, sparsify as S, statistics as T
from thicket.sources import fixtures


def near(a, b):
    return math.isclose(a, b, abs_tol=2e-9)


def test_karate(spark):
    edges, labels = fixtures.karate(spark)
    t = T.theory(edges, labels).first()
    assert (t.n1, t.n2, t.m) == (67, 11, 78)
    for name, value in {"mu_intra": 0.450745049, "mu_inter": 0.345461973, "delta": 0.105283077, "f_original": 0.858974359, "g_original": 0.500739645, "ratio_predicted": 0.766424331, "f_weighted": 0.888232891, "f_improvement": 0.029258532, "g_weighted": 0.500064509, "g_change": -0.000675136, "q_lower_bound": 0.029933668}.items():
        assert near(t[name], value), name
    assert near(T.modularity_terms(edges, labels).first().q, 0.358234714)
    h = T.hub_bridge(edges, labels).first()
    assert abs(h.difference - 13.723202) < 1e-6 and near(h.ratio, 1.306791640)


def test_barbell_and_grid(spark):
    edges, labels = fixtures.barbell(spark, 10)
    t, h = T.theory(edges, labels).first(), T.hub_bridge(edges, labels).first()
    assert (t.n1, t.n2) == (90, 1) and near(t.mu_intra, 0.22) and near(t.mu_inter, 0.2)
    assert near(h.difference, 17.2) and near(h.ratio, 1.207729469) and near(t.g_original, 0.5)
    edges, labels = fixtures.grid(spark, 10)
    t = T.theory(edges, labels).first()
    assert (t.n1, t.n2) == (160, 20) and near(t.delta, 0.025) and near(t.f_original, 0.888888889)


def test_one_class_is_empty(spark):
    edges = fixtures.edges_of(spark, [(0, 1), (1, 2)])
    same = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "id long, comm long")
    s = T.separation(edges, same).first()
    assert s.mu_inter == 0 and s.mu_intra == 1.5
    assert tuple(T.separation(edges, same, strict=True).first()) == (0, 0, 0)
    assert tuple(T.hub_bridge(edges, same).first()) == (0, 2, 0, 0)
    p = T.preservation(edges, S.top_k(edges, 0.5), same).first()
    assert (p.inter_rate, p.ratio, p.supported) == (0, 0, False)
    assert T.preservation(edges, S.top_k(edges, 0.5), same, empty_rate=1.0).first().ratio == 2.0


def test_infinite_ratio(spark):
    edges = fixtures.edges_of(spark, [(0, 1), (1, 2)])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, comm long")
    assert T.preservation(edges, edges.filter("src = 1"), labels).first().ratio == math.inf


def test_partial_labels(spark):
    edges = fixtures.edges_of(spark, [(0, 1), (1, 2), (2, 3)])
    labels = spark.createDataFrame([(0, 0), (1, 0)], "id long, comm long")
    assert T.classified(edges, labels).count() == 1
    assert {(r.src, r.is_intra) for r in T.classified(edges, labels, "equal").collect()} == {(0, True), (1, False), (2, True)}
    assert {r.comm_dst for r in T.classified(edges, labels, "sentinel").collect()} == {0, -1}
    assert T.label_modularity(edges, labels, spark.range(4)).first().q is None


def test_changes_add_up(spark):
    edges, labels = fixtures.karate(spark)
    for method in ("deterministic", "probabilistic_no_replace"):
        r = T.reconstruction(edges, S.sparsify(edges, method, 0.6), labels).first()
        assert r.epsilon < 1e-10 and math.isclose(r.dq, r.dq_reconstructed, abs_tol=1e-12)


def test_agreement(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, comm long")
    b = spark.createDataFrame([(i, (i % 3 + 1) * 10) for i in range(30)], "id long, comm long")
    one = spark.createDataFrame([(i, 0) for i in range(30)], "id long, comm long")
    assert math.isclose(agreement.nmi(a, b).first()[0], 1) and math.isclose(agreement.ari(a, b).first()[0], 1)
    assert agreement.nmi(one, one).first()[0] == 1 and agreement.ari(one, one).first()[0] == 1
    assert abs(agreement.nmi(a, one).first()[0]) < 1e-12 and abs(agreement.ari(a, one).first()[0]) < 1e-12


def test_misclassification(spark):
    edges = fixtures.edges_of(spark, [(0, 1), (1, 2), (2, 3)])
    found = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, comm long")
    truth = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "id long, comm long")
    r = T.misclassification(edges, edges.filter("src <> 1"), found, truth).first()
    assert (r.inter_removed, r.inter_removed_but_intra, r.intra_preserved, r.intra_preserved_but_inter) == (1, 1, 2, 1)
    assert (r.removed_rate, r.preserved_rate) == (1, 0.5)


@pytest.mark.parametrize("ratio", [0.1, 0.5])
def test_noise(spark, ratio):
    from thicket.graph.generators import noise_edges

    edges, labels = fixtures.karate(spark)
    noise = noise_edges(edges, labels, ratio)
    assert noise.count() == int(78 * ratio)
    assert noise.join(edges, ["src", "dst"]).count() == 0
    assert T.noise_statistics(edges, noise, labels).first().n_added == int(78 * ratio)
