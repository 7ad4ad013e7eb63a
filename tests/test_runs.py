"""Grids as runs, fronts and fits."""

import math
import random
import time

import pytest

from thicket.operators import frontier
from thicket.plans import runs


def test_run_and_resume(spark, tmp_path):
    """Side by side, with a late, a failing and a breaking trial; a run that goes on repeats nothing that is done."""
    seen = []

    def trial(dataset, method, x):
        seen.append((method, x))
        if method == "spectral":
            spark.range(1 << 40).selectExpr("sum(hash(id))").collect()
        if x == 3:
            raise ValueError("three")
        if x == 4 and seen.count((method, 4)) == 1:
            raise KeyError("a fault")
        return {"method": method, "total": spark.range(x + 1).selectExpr("sum(id)").first()[0]}

    grid = [("d", {"method": "score", "x": x}) for x in range(5)] + [("e/f", {"method": "score", "x": 1})]
    run = lambda trials, **how: runs.run_trials(spark, trial, trials, str(tmp_path / "ledger"), "method string, total long", **how)
    with pytest.raises(KeyError):
        run(grid)
    begun = len(seen)
    rows = run(grid)
    assert sorted((r.dataset, r.total) for r in rows.collect()) == [("d", 0), ("d", 1), ("d", 3), ("d", 10), ("e/f", 1)]
    assert seen[begun:].count(("score", 0)) == 0 and ("score", 3) in seen[begun:] and ("score", 4) in seen[begun:]

    class Short(runs.Limits):
        def of(self, arguments):
            return 1.0 if arguments["method"] == "spectral" else 60.0

    begun = len(seen)
    assert run([*grid[:3], ("d", {"method": "spectral", "x": 0})], limits=Short()).count() == 5
    assert seen[begun:] == [("spectral", 0)]
    log = {r.batch: r.state for r in runs.run_log(spark, str(tmp_path / "ledger")).collect()}
    assert sorted(log.values()) == ["done"] * 5 + ["failed", "late"]


def test_limits():
    limits = runs.Limits(100)
    assert limits.of({"method": "spectral"}) == 300 and limits.of({"method": "paper"}) == 100
    limits.took({"method": "paper"}, 7.5)
    limits.took({"method": "spectral"}, 90)
    assert limits.of({"method": "spectral"}) == 75


def test_datasets_and_citation_grid(spark):
    """A dataset that can't be loaded gives no rows; the grid has a row for each method, and the sweep of resolutions."""
    from thicket.plans import experiments
    from thicket.sources import fixtures

    def load(name):
        if name == "none":
            raise ValueError(name)
        return fixtures.barbell(spark, 4)

    rows = experiments.run_datasets(spark, load, ["none", "bell"], lambda edges, labels, alpha: experiments.sampling_trial(edges, labels, "deterministic", alpha, 1), [(0.5,)])
    assert [(r.dataset, r.m_sparse) for r in rows.collect()] == [("bell", 7)]
    bell = fixtures.barbell(spark, 4)[0]
    found = experiments.citation_grid(bell, retentions=(0.5,), epsilons=(), resolutions=(0.1,), small=True).collect()
    assert [r.method for r in found[:3]] == ["paper", "probabilistic_no_replace", "deterministic"] and found[3].method.endswith("+cpm")


def test_pareto(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice((None, float("nan"), *map(float, range(30)))), rng.randrange(40) - x if (x := rng.randrange(3)) else None) for i in range(400)]
    rows += [(1000 + i, float(i), i) for i in range(30)]
    ok = [r for r in rows if r[1] is not None and r[1] == r[1] and r[2] is not None]
    front = sorted(a[0] for a in ok if not any(b[1] <= a[1] and b[2] >= a[2] and (b[1] < a[1] or b[2] > a[2]) for b in ok))
    df = spark.createDataFrame(rows, "id long, cost double, quality long").repartition(5)
    assert sorted(r.id for r in frontier.pareto(df, "cost", "quality").collect()) == front
    assert frontier.pareto(df.limit(0), "cost", "quality").count() == 0


def test_power_fit(spark):
    df = spark.createDataFrame([("a", x, 3.0 * x**1.5) for x in (1.0, 2.0, 5.0, 0.0)] + [("b", 2.0, 7.0)], "k string, x double, y double")
    rows = {r.k: r for r in frontier.power_fit(df, "x", "y", ["k"]).collect()}
    assert rows["a"].n == 3 and math.isclose(rows["a"].exponent, 1.5) and math.isclose(rows["a"].factor, 3.0) and math.isclose(rows["a"].r2, 1.0)
    assert rows["b"].exponent is None


def test_gml(spark, tmp_path):
    """Blocks over lines or within one, nested blocks, comments, strings with brackets and fields that are repeated or lack."""
    from thicket.sources import files

    f = tmp_path / "g.gml"
    f.write_text('# made by hand [\nCreator "a [ b"\ngraph\n[\n directed 0\n node [ id 1 value "l" ]\n node\n [\n id 2\n graphics [ x 1 id 99 y 2 ]\n label "n ] 2" value "c" value "l"\n ] node [ id 3 ]\n node [ id 4 value "12" ] node [ label "none" ]\n edge [ source 2 target 1 ]\n edge [ target 3 w 1.5 source 2 ] edge [ source 1 target 2 ] edge [ source 4 ] edge [ ]\n]\n')
    edges, labels = files.read_gml(spark, str(f))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3)]
    assert {r.id: r.comm for r in labels.collect()} == {1: 0, 2: 2, 3: 1, 4: 12}
