"""Rounds within one stage: the same results as by a chain of jobs, which they don't need."""

import os

import numpy as np

from thicket.graph import communities, halves, homes, resistance, spectrum


def graph(spark, n=300, m=1500):
    rng = np.random.default_rng(5)
    ends = rng.integers(0, n, (m, 2))
    ends = np.where((rng.random(m) < 0.8)[:, None], ends[:, :1] // 60 * 60 + ends % 60, ends) % n
    return spark.createDataFrame(sorted({(int(min(p)), int(max(p))) for p in ends if p[0] != p[1]}), "src long, dst long").localCheckpoint()


def test_leiden_rounds_are_one_stage(spark, monkeypatch):
    edges = graph(spark)
    monkeypatch.setattr(homes, "FEW", 1000)
    rounds = []
    monkeypatch.setattr(homes.Homes, "round", lambda self, *a, f=homes.Homes.round: rounds.append(self.homes) or f(self, *a))
    side = {r.id: r.comm for r in communities.leiden_parallel(edges).collect()}
    assert not rounds
    monkeypatch.setattr(homes, "places", lambda spark: 0)
    assert {r.id: r.comm for r in communities.leiden_parallel(edges).collect()} == side and max(rounds) > 1


def test_lanczos_steps_are_one_stage(spark, monkeypatch):
    edges, written = graph(spark), []
    monkeypatch.setattr(spectrum, "KEPT", 20)
    monkeypatch.setattr(spectrum, "written", lambda *a, f=spectrum.written: written.append(a[2]) or f(*a))
    value, residual, vector = spectrum.second_eigenpair(edges, 1e-6)
    side = {r.id: r.x for r in vector.collect()}
    assert not written and residual < 1e-5
    monkeypatch.setattr(spectrum, "places", lambda spark: 0)
    other, _, vector = spectrum.second_eigenpair(edges, 1e-6)
    again = {r.id: r.x for r in vector.collect()}
    assert written and abs(value - other) < 1e-8 and abs(abs(sum(side[i] * x for i, x in again.items())) - 1) < 1e-6  # its sign is open


def test_swaps_are_one_stage(spark, monkeypatch):
    edges, cuts = graph(spark), []
    monkeypatch.setattr(halves, "SHARE", 0.5)
    start = spark.range(300).join(edges.selectExpr("explode(array(src, dst)) AS id").distinct(), "id").selectExpr("id", "id % 2 AS comm", "1.0D AS d", "id % 2 + id / 1e6 AS x")
    n = start.count()
    monkeypatch.setattr(halves, "eigenpair_of", lambda graph, tolerance: (0.0, 0.0, start.select("id", "d", "x")))
    monkeypatch.setattr(halves, "_cut", lambda *a, f=halves._cut: cuts.append(1) or f(*a))
    side = {r.id: r.comm for r in halves.bisection(edges).collect()}
    assert not cuts and sum(side.values()) == n - n // 2
    monkeypatch.setattr(halves, "gang_of", lambda graph: 0)
    assert {r.id: r.comm for r in halves.bisection(edges).collect()} == side and len(cuts) > 3


def test_rounds_of_gradients_leave_few_files(spark, monkeypatch):
    edges, folders = graph(spark, 60, 300), []
    monkeypatch.setattr(resistance, "written", lambda *a, f=resistance.written: folders.append(f(*a)) or folders[-1])
    got = {(r.src, r.dst): r.resistance for r in resistance.sketched(edges, 400, tolerance=1e-6).collect()}
    there = [f for f, _ in folders if os.path.exists(f.removeprefix("file:"))]
    assert len(folders) > 6 and len(there) <= 2
    exact = resistance.exact(edges.selectExpr("'g' AS graph_id", "src", "dst")).collect()
    assert len(got) == len(exact) and all(abs(got[r.src, r.dst] / r.resistance - 1) < 0.5 for r in exact)
    assert abs(sum(got.values()) / sum(r.resistance for r in exact) - 1) < 0.03
